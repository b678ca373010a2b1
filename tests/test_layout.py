"""The bucketed statement log: attribution without a shuffle at any size of the cluster map, hot clusters split."""

import uuid

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from idlecost.plans import CustomerAnalysis, RegionAnalysis
from idlecost.sources import layout, load_inputs
from idlecost.sources.fixtures import CUSTOMER_PARAMS, REGION_PARAMS, bucketed_fixture_inputs, load_fixture_inputs

from test_plans import _ancestors, _plan

THRESHOLDS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.fixture
def no_broadcast(spark):
    saved = {k: spark.conf.get(k) for k in THRESHOLDS}
    for k in THRESHOLDS:
        spark.conf.set(k, "-1")
    yield
    for k, v in saved.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("kind,params", [(CustomerAnalysis, CUSTOMER_PARAMS), (RegionAnalysis, REGION_PARAMS)])
def test_log_is_not_shuffled_above_the_broadcast_threshold(spark, no_broadcast, kind, params):
    got = kind(bucketed_fixture_inputs(spark, SF_SMALL), params).statements
    path = _ancestors(_plan(got), "idlecost_statements")
    assert any("ShuffledHashJoin" in op for op in path) and not [op for op in path if "Exchange" in op], path
    plain = kind(load_fixture_inputs(spark, SF_SMALL), params).statements
    assert any("Exchange" in op for op in _ancestors(_plan(plain), "value:double,props:string>"))  # the plain log is
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def _table(spark, statements, buckets):
    name = f"layout_{uuid.uuid4().hex}"
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    layout.write_statement_log(statements, name, buckets, path)
    return name


def test_hot_cluster_is_split(spark):
    """A quarter of all statements runs on one cluster: no bucket holds much more than its share."""
    bucketed_fixture_inputs(spark, SF_SMALL)  # sets the shared folder
    log = load_fixture_inputs(spark, SF_SMALL).statements
    table = spark.table(_table(spark, log, 16))
    share = log.count() / 16
    assert max(r[0] for r in log.groupBy("cluster_id").count().select("count").collect()) > 4 * share
    sizes = [r[1] for r in table.groupBy(F.pmod(F.hash("cluster_id", "salt"), F.lit(16))).count().collect()]
    assert max(sizes) < 3 * share
    assert sorted(map(tuple, table.select(*log.columns).collect()), key=repr) == sorted(map(tuple, log.collect()), key=repr)


def test_days_are_appended(spark):
    bucketed_fixture_inputs(spark, SF_SMALL)
    log = load_fixture_inputs(spark, SF_SMALL).statements
    name = _table(spark, log.where("date < '2024-01-20'"), 8)
    layout.append_statements(log.where("date >= '2024-01-20'"), name)
    inputs = load_inputs(spark, {"statements": name})
    assert inputs.layout.buckets == 8 and inputs.layout.salts.count() > 0
    assert sorted(map(tuple, inputs.statements.select(*log.columns).collect()), key=repr) == sorted(map(tuple, log.collect()), key=repr)
    spark.range(1).write.option("path", f"{spark.sparkContext.getCheckpointDir()}/{name}_plain").saveAsTable(f"{name}_plain")
    assert layout.layout_of(spark, f"{name}_plain") is None
    with pytest.raises(ValueError, match="write_statement_log"):
        layout.append_statements(log, f"{name}_plain")
