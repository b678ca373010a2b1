"""N-gram Jaccard join over a token-group matrix, exact at a similarity of 0.8.

A document's tokens are its distinct five-word shingles.  Two sets link when
100 * |x & y| >= 80 * |x | y|; the result is the connected components of all links.

1. Sets: each text becomes sorted 64-bit shingle hashes; equal sets share a set key.
2. Shared tokens: tokens go to buckets of the hash space in packed blobs; a bucket
   keeps those that two sets have or more, with their number of sets, and sends
   them back to their sets.  A set that shares under 80 % of its tokens has no link.
   Tokens that nobody shares can't be in an intersection, so nothing else is needed.
3. Groups: for each of ``MIN_HASHES`` min-hashes the sets that share it are compared
   with one leader, the one whose tokens occur in most sets (the middle of a family of
   near copies).  The components of the links found are the groups: connected, each
   with a leader, and made without pairs inside a group.
4. Matrix: links run from a larger set y to a smaller x, which needs an overlap of 8/9
   of x and 4/9 of both sizes together.  So with the tokens of both in one order
   (rarest first) x's first n - ceil(8n/9) + 1 tokens hold one of y's first
   n - ceil(4(n + n_x)/9) + 1.  The matrix holds these tokens of the members of each
   group and size class (sizes within ``SIZE_STEP``); a query meets only other groups
   that its own tokens hit.  Its overlap with the token union of the group's class
   bounds its overlap with each member; classes below what a link needs stay closed.
5. Opened groups: first the leader is compared, then, where group and query are
   still apart, the members that hit one of the query's tokens.
6. Components of all links by alternating large and small stars.

Defined cases: null counts as empty; without words a document has no tokens and
links with nothing; copies and repeated rows have the same set, hence one component;
null ids take part but never name a component unless all its ids are null; an empty
table gives an empty result; other columns are ignored here and returned unchanged by
``near_dedup``.  Words, shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from idlecost.llm.common import full_text, shuffle_partitions, stored, table, with_ids, without_ids
from idlecost.llm.wordhash import LOWER_AZ, free_memory, mix, slices, window_hashes, word_hashes, words

SHINGLE = 5
#: A link: PERCENT * union <= 100 * intersection.
PERCENT = 80
#: Min-hashes by which sets meet leaders.
MIN_HASHES = 4
#: Sizes of one class of a group differ by this factor at most.
SIZE_STEP = 1.03
#: Members whose tokens are put together at once, and tokens of a union in one row.
PART, SLOT = 64, 20_000
#: Tokens that are packed into blobs at once.
BLOB_TOKENS = 1 << 20


# --- 1. sets ------------------------------------------------------------------

def _sets(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each text) by slice."""
    for at, _, data, offset in slices(texts):
        w = words(LOWER_AZ[data], offset)
        h = word_hashes(w)
        grams = window_hashes(h, SHINGLE)
        out = []
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                s = np.sort(grams[a:b - SHINGLE + 1])
                keep = np.ones(len(s), dtype=bool)
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                out.append(s[keep])
            elif b > a:  # the whole sequence as one, told apart from windows by its length
                short = h[a:b].copy()
                for k in range(1, b - a):
                    short[0] = mix(short[:1] * np.uint64(31) ^ short[k:k + 1])[0]
                out.append(mix(short[:1] + np.uint64(b - a)))
            else:
                out.append(grams[:0])
        yield at, out


def _set_key(s: np.ndarray) -> np.uint64:
    """A 64-bit key of a sorted set: position-free sum of mixed tokens and its size."""
    return mix(np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))], dtype=np.uint64))[0]


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, sets in _sets(batch.column("text")):
            keys = np.array([_set_key(s) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").slice(at, len(sets)), "n_shingles": pa.array(n),
                "set_key": pa.array(keys, mask=n == 0)})
    free_memory()


# --- 2. shared tokens ---------------------------------------------------------
# A blob: number of sets, then for each its key, size and number of tokens, then the
# tokens' upper 48 bits (the lower 16 choose the bucket), then set counts if wanted.

def _pack(keys: np.ndarray, sizes: np.ndarray, counts: np.ndarray, tokens: np.ndarray, found: np.ndarray | None = None) -> bytes:
    six = (tokens >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    parts = [np.array([len(keys)], "<u4"), keys.astype("<u8"), sizes.astype("<u4"), counts.astype("<u4"), np.ascontiguousarray(six)]
    return b"".join(x.tobytes() for x in parts + ([] if found is None else [found.astype("<u2")]))


def _unpack(blob: bytes, with_found: bool = False) -> tuple[np.ndarray, ...]:
    m = int(np.frombuffer(blob, "<u4", 1)[0])
    keys = np.frombuffer(blob, "<u8", m, 4)
    sizes, counts = np.frombuffer(blob, "<u4", 2 * m, 4 + 8 * m).reshape(2, m)
    n = int(counts.sum())
    eight = np.zeros((n, 8), dtype=np.uint8)
    eight[:, 2:] = np.frombuffer(blob, np.uint8, 6 * n, 4 + 16 * m).reshape(n, 6)
    tokens = eight.view("<u8").reshape(n)
    return (keys, sizes, counts, tokens, np.frombuffer(blob, "<u2", n, 4 + 16 * m + 6 * n)) if with_found else (keys, sizes, counts, tokens)


def _blobs(to: np.ndarray, key: np.ndarray, size: np.ndarray, token: np.ndarray, found: np.ndarray | None = None):
    """Blobs by bucket; rows come ordered by set, and keep that order inside a bucket."""
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    for part in np.split(order, cuts):
        if not len(part):
            continue
        k = key[part]
        head = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
        counts = np.diff(np.append(head, len(part)))
        yield int(to[part[0]]), _pack(k[head], size[part][head], counts, token[part], None if found is None else found[part])


def _blob_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in rows], pa.int32()),
                                       "blob": pa.array([x for _, x in rows], pa.binary())})


def _token_blobs(buckets: int):
    def packed(own: dict[int, np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in own.values()])
        token = np.concatenate(list(own.values()))
        to = ((token & np.uint64(0xFFFF)) * np.uint64(buckets) >> np.uint64(16)).astype(np.uint16)
        return _blob_batch(list(_blobs(to, np.repeat(np.array(list(own), dtype=np.uint64), sizes), np.repeat(sizes, sizes), token)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = {}, 0  # copies that come together once
        for batch in batches:
            for _, sets in _sets(batch.column("text")):
                for s in sets:
                    if len(s):
                        own[int(_set_key(s))] = s
                        n += len(s)
                if n >= BLOB_TOKENS:
                    yield packed(own)
                    own, n = {}, 0
        if own:
            yield packed(own)
        free_memory()
    return run


def _shared(buckets: int):
    """Of a bucket's tokens those of two sets or more, back to buckets of set keys."""
    def of_bucket(bucket: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        got = [_unpack(x) for x in blobs]
        keys, sizes, counts = (np.concatenate([g[i] for g in got]) for i in range(3))
        token = np.concatenate([g[3] for g in got])
        del got
        key, first, at = np.unique(keys, return_index=True, return_inverse=True)
        size = sizes[first]
        owner = np.repeat(at.astype(np.uint32), counts)
        order = np.argsort(token)
        token, owner = token[order], owner[order]
        same = token[1:] == token[:-1]
        twice = np.zeros(len(token), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        token, owner = token[twice], owner[twice]
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        new = np.ones(len(token), dtype=bool)  # a set once a token
        new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        token, owner = token[new], owner[new]
        if not len(token):
            return
        start = np.concatenate([[True], token[1:] != token[:-1]])
        run = np.cumsum(start) - 1
        found = np.bincount(run)[run]
        many = found > 1
        token, owner, found = token[many], owner[many], np.minimum(found[many], 0xFFFF)
        order = np.argsort(owner, kind="stable")
        token, owner, found = token[order], owner[order], found[order]
        to = (key[owner] % np.uint64(buckets)).astype(np.uint16)
        rows = [(b, np.array([bucket], "<u4").tobytes() + x) for b, x in _blobs(to, key[owner], size[owner], token, found)]
        if rows:
            yield _blob_batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_bucket(batches, of_bucket)
    return run


def _by_bucket(batches: Iterator[pa.RecordBatch], of_bucket) -> Iterator[pa.RecordBatch]:
    """Apply to all blobs of each bucket of the partition (one bucket in one partition)."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for b, x in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            held.setdefault(b, []).append(x)
    for b in sorted(held):
        yield from of_bucket(b, held.pop(b))


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets that share enough tokens to link at all, with these tokens, rarest first."""
    def of_bucket(_: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        got = []
        for x in blobs:
            source = np.frombuffer(x, "<u4", 1)[0].astype(np.uint64)
            k, s, c, t, f = _unpack(x[4:], True)
            got.append((k, s, c, t | source, f))
        keys, sizes, counts, token, found = (np.concatenate([g[i] for g in got]) for i in range(5))
        del got
        key, first, at = np.unique(keys, return_index=True, return_inverse=True)
        size = sizes[first].astype(np.int64)
        have = np.bincount(at, weights=counts).astype(np.int64)
        able = 100 * have >= PERCENT * size
        owner = np.repeat(at, counts)
        keep = able[owner]
        owner, token, found = owner[keep], token[keep], found[keep]
        order = np.lexsort((token, found, owner))
        lengths = have[able]
        fame = (np.bincount(owner, weights=found, minlength=len(key))[able] + (size - have)[able]) / size[able]
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        values = pa.array(token[order].view(np.int64))
        at = np.flatnonzero(able)
        for a in range(0, len(at), 2000):
            b = min(a + 2000, len(at))
            yield pa.RecordBatch.from_pydict({
                "set_key": pa.array(key[at[a:b]].view(np.int64)), "n": pa.array(size[at[a:b]]), "fame": pa.array(fame[a:b]),
                "tokens": pa.ListArray.from_arrays(pa.array(offsets[a:b + 1] - offsets[a]), values.slice(offsets[a], offsets[b] - offsets[a]))})
    yield from _by_bucket(batches, of_bucket)


def _linkable_sets(texts: DataFrame) -> DataFrame:
    """set_key, n, fame, tokens of every set that could have a link.

    ``tokens`` are the shared ones, rarest first; ``fame`` is the mean number of sets
    that hold one of the set's tokens.
    """
    buckets = min(shuffle_partitions(texts.sparkSession), 65_536)
    blobs = texts.select("text").mapInArrow(_token_blobs(buckets), "bucket int, blob binary")
    shared = blobs.repartitionById(buckets, "bucket").mapInArrow(_shared(buckets), "bucket int, blob binary")
    return shared.repartitionById(buckets, "bucket").mapInArrow(_survivors, "set_key long, n long, fame double, tokens array<long>")


# --- 3. to 5. groups, matrix, opened groups ------------------------------------

def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of set keys that link."""
    x = sets.select(F.col("set_key").alias("a"), F.col("n").alias("_na"), F.col("tokens").alias("_ta"))
    y = sets.select(F.col("set_key").alias("b"), F.col("n").alias("_nb"), F.col("tokens").alias("_tb"))
    both = F.size(F.array_intersect("_ta", "_tb"))
    return pairs.join(x, "a").join(y, "b").where(
        (100 * F.col("_na") >= PERCENT * F.col("_nb")) & (100 * F.col("_nb") >= PERCENT * F.col("_na"))
        & (100 * both >= PERCENT * (F.col("_na") + F.col("_nb") - both))).select(*pairs.columns)


def _min_hash(seed: int):
    return F.array_min(F.transform("tokens", lambda t: F.xxhash64(t, F.lit(seed))))


def _groups(sets: DataFrame) -> DataFrame:
    """set_key, head, leader: each set's group, named by its smallest key, and the group's leader."""
    hashes = sets.select("set_key", "fame", F.posexplode(F.array(*[_min_hash(k) for k in range(MIN_HASHES)])).alias("k", "m"))
    hashes = stored(hashes, "min-hashes")
    leaders = hashes.groupBy("k", "m").agg(F.max(F.struct("fame", "set_key")).alias("_top"), F.count("*").alias("_n"))
    leaders = leaders.where("_n > 1").select("k", "m", F.col("_top.set_key").alias("b"))
    pairs = hashes.join(leaders, ["k", "m"]).where("set_key <> b").select(F.col("set_key").alias("a"), "b").distinct()
    label = sets.select("set_key", F.col("set_key").alias("head"), "fame")
    label = _relabel(label, stored(_linked(pairs, sets), "leader-pairs"), "groups")
    leader = label.groupBy("head").agg(F.max(F.struct("fame", "set_key")).alias("_top"))
    return stored(label.join(leader, "head").select("set_key", "head", F.col("_top.set_key").alias("leader")), "labels")


def _components(links: DataFrame) -> DataFrame:
    """node, root of every node of the undirected links (a, b): the smallest node it reaches.

    Alternating stars: every node's larger neighbours, then its smaller ones, are
    hooked to its smallest; the links become stars within a few rounds.
    """
    links = stored(links.select("a", "b").where("a <> b").distinct(), "links")
    while True:
        both = links.union(links.select("b", "a"))
        low = both.groupBy(F.col("a").alias("_u")).agg(F.least(F.min("b"), F.first("a")).alias("_m"))
        large = both.join(low, F.col("a") == F.col("_u")).where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        large = stored(large.where("a <> b").distinct(), "large-star")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy(F.col("a").alias("_u")).agg(F.min("b").alias("_m"))
        small = down.join(low, F.col("a") == F.col("_u")).select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("_m").alias("b")), F.struct("a", F.col("_m").alias("b")))).alias("p")
        ).select("p.a", "p.b").where("a <> b").distinct()
        small = stored(small, "small-star")
        # Done when every node has one smaller neighbour and no such neighbour has one itself.
        many = small.groupBy("a").agg(F.count("*").alias("_n")).where("_n > 1").select("a")
        deep = small.select(F.col("b").alias("a")).distinct().join(small.select("a"), "a", "left_semi")
        links = small
        if many.union(deep).isEmpty():
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b")).distinct()


def _relabel(label: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``label`` with the heads that ``links`` connect replaced by one of them."""
    if links.isEmpty():
        return label
    roots = _components(links)
    return stored(label.join(roots, F.col("head") == F.col("node"), "left").select(
        F.coalesce("root", "head").alias("head"), *[c for c in label.columns if c != "head"]), name)


def _asked(probes: DataFrame) -> DataFrame:
    """a, n, tokens_of, group, cls, lo: the classes of other groups that a set must be compared with."""
    matrix = probes.where("in_matrix").groupBy("token", F.col("head").alias("group"), "cls").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    met = probes.select("token", "rank", F.col("set_key").alias("a"), "n", "head").join(matrix, "token").where(
        "head <> group AND lo <= n AND 5 * hi >= 4 * n AND rank <= n - (4 * (n + lo) + 8) div 9 + 1")
    return met.groupBy("a", "n", "group", "cls").agg(F.min("lo").alias("lo"))


def _bounded(asked: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """The asked classes whose token union the query overlaps enough to open them."""
    tokens = sets.select("set_key", "tokens")
    of = members.join(asked.select("group", "cls").distinct(), ["group", "cls"])
    parts = of.groupBy("group", "cls").agg(F.ceil(F.count("*") / PART).alias("_parts"))
    # Near copies have most tokens in common: small parts shrink before the whole is put together.
    of = of.join(parts, ["group", "cls"]).withColumn("_part", F.pmod(F.xxhash64("set_key"), "_parts")).repartition("group", "cls", "_part")
    some = of.join(tokens, "set_key").groupBy("group", "cls", "_part").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"))
    union = stored(some.select("group", "cls", F.explode("tokens").alias("token")).distinct(), "unions")
    slots = union.groupBy("group", "cls").agg(F.ceil(F.count("*") / SLOT).cast("int").alias("_slots"))
    union = union.join(slots, ["group", "cls"]).groupBy("group", "cls", F.pmod("token", "_slots").cast("int").alias("slot")).agg(
        F.collect_list("token").alias("_union"))
    query = asked.join(slots, ["group", "cls"]).join(tokens.withColumnRenamed("set_key", "a"), "a")
    query = query.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("_slots") - 1)))
    most = query.join(union, ["group", "cls", "slot"]).groupBy("a", "n", "group", "cls", "lo").agg(
        F.sum(F.size(F.array_intersect("tokens", "_union"))).alias("_most"))
    return most.where("9 * _most >= 4 * (n + lo)").select("a", "n", "group", "cls")


def _connected_sets(sets: DataFrame) -> DataFrame:
    """set_key, head: the component of every set that could have a link."""
    label = _groups(sets)
    places = sets.select("set_key", "n", F.size("tokens").alias("_s"), F.posexplode("tokens").alias("_at", "token"))
    # A token's place in its set; the tokens that nobody shares come first.
    places = places.withColumn("rank", F.col("n") - F.col("_s") + F.col("_at") + 1).where("rank <= n - (4 * n + 4) div 5 + 1")
    probes = places.select("set_key", "n", "token", "rank", F.expr("rank <= n - (8 * n + 8) div 9 + 1").alias("in_matrix"),
                           F.floor(F.log("n") / F.log(F.lit(SIZE_STEP))).alias("cls")).join(label.select("set_key", "head"), "set_key")
    met = probes.groupBy("token").agg(F.min("head").alias("_lo"), F.max("head").alias("_hi"), F.max("in_matrix").alias("_in"))
    probes = stored(probes.join(met.where("_lo <> _hi AND _in").select("token"), "token", "left_semi"), "probes")
    asked = stored(_asked(probes), "asked")
    if asked.isEmpty():
        return label.select("set_key", "head")
    members = sets.select("set_key", F.floor(F.log("n") / F.log(F.lit(SIZE_STEP))).alias("cls")).join(label, "set_key").select(
        "set_key", F.col("head").alias("group"), "cls")
    opened = stored(_bounded(asked, members, sets), "opened")

    leaders = label.select(F.col("head").alias("group"), F.col("leader").alias("b")).distinct()
    own = label.select(F.col("set_key").alias("a"), F.col("head").alias("_own"))
    to_leader = _linked(opened.select("a", "group").distinct().join(leaders, "group").select("a", "b", "group"), sets)
    links = stored(to_leader.join(own, "a").select(F.col("_own").alias("a"), F.col("group").alias("b")).distinct(), "leader-links")
    now = _relabel(label.select("set_key", "head", F.col("head").alias("group")), links, "merged")
    groups = now.select("group", F.col("head").alias("_now")).distinct()
    still = opened.join(own, "a").join(groups.withColumnsRenamed({"group": "_own", "_now": "_mine"}), "_own").join(groups, "group")
    still = stored(still.where("_mine <> _now").select("a", "n", "group", "cls"), "still-apart")
    if still.isEmpty():
        return now.select("set_key", "head")
    mine = probes.select(F.col("set_key").alias("a"), "rank", "token").join(still, "a")
    theirs = probes.where("in_matrix").select(F.col("set_key").alias("b"), F.col("n").alias("_nb"), "token", F.col("head").alias("group"), "cls")
    pairs = mine.join(theirs, ["group", "cls", "token"]).where(
        "_nb <= n AND 5 * _nb >= 4 * n AND rank <= n - (4 * (n + _nb) + 8) div 9 + 1").select("a", "b").distinct()
    heads = now.select("set_key", F.col("head").alias("_now"))
    links = (_linked(pairs, sets).join(heads.withColumnsRenamed({"set_key": "a", "_now": "_x"}), "a")
             .join(heads.withColumnsRenamed({"set_key": "b", "_now": "_y"}), "b")
             .select(F.col("_x").alias("a"), F.col("_y").alias("b")).distinct())
    return _relabel(now.select("set_key", "head"), stored(links, "member-links"), "merged-members").select("set_key", "head")


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, set_key, component_id, stay_key: the component of every row of
    ``docs``, and of the sets that have the component's smallest id the smallest key."""
    texts = docs.select(F.col(id_col).alias("doc_id"), full_text(text_col).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    rows = stored(texts.mapInArrow(_set_rows, f"doc_id {id_type}, n_shingles long, set_key long"), "sets")
    sets = stored(_linkable_sets(texts), "linkable")
    label = _connected_sets(sets).select("set_key", "head").withColumnsRenamed({"set_key": "_key", "head": "_head"})
    keyed = rows.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("_id"))
    keyed = keyed.join(label, F.col("set_key") == F.col("_key"), "left").select(
        "set_key", "_id", F.coalesce("_head", "set_key").alias("_head"))
    # Only groups of several sets need their smallest id looked up; a null id comes last.
    named = keyed.join(label.select("_head").distinct(), "_head", "left_semi").groupBy("_head").agg(
        F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("set_key").alias("key"))).alias("_least"))
    several = F.col("_least").isNotNull()
    ids = keyed.join(named, "_head", "left").select(
        "set_key", F.when(several, F.col("_least.id")).otherwise(F.col("_id")).alias("_component"),
        F.when(several, F.col("_least.key")).otherwise(F.col("set_key")).alias("stay_key"))
    return rows.join(ids, "set_key", "left").select(
        "doc_id", "n_shingles", "set_key",
        F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col("doc_id")).alias("component_id"), "stay_key")


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    return _labelled(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def _keyed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the set key of ``_text`` (null without words) in its place."""
    for batch in batches:
        names = [n for n in batch.schema.names if n != "_text"]
        for at, sets in _sets(batch.column("_text")):
            keys = np.array([_set_key(s) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({n: batch.column(n).slice(at, len(sets)) for n in names}
                                             | {"_set_key": pa.array(keys, mask=np.array([not len(s) for s in sets], dtype=bool))})


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays, that of the smallest id, all columns unchanged.

    A row is told by its id and its set, so ids may repeat or be null: of the sets with
    a component's smallest id (null comes last) the one with the smallest key stays, and
    of several rows with that id and set the first in the order of their columns.
    Documents without words stay.
    """
    found = _labelled(docs, id_col, text_col)
    stays = (F.col("n_shingles") == 0) | ((F.col("set_key") == F.col("stay_key")) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    found = stored(found.select("doc_id", "set_key", stays.alias("stays")), "components")
    kept = found.where("stays").select(F.col("doc_id").alias("_kept"), F.col("set_key").alias("_kept_key"))
    again = kept.where("_kept_key IS NOT NULL").groupBy("_kept", "_kept_key").agg(F.count("*").alias("_n")).where("_n > 1")
    moved = stored(found.where("NOT stays").select("doc_id").union(again.select("_kept")).toDF("_moved").distinct(), "moved-ids")
    main = without_ids(docs, id_col, moved)
    # An id of which some rows go and others stay: only these rows' sets are made again.
    both = stored(moved.join(kept.select("_kept").distinct(), F.col("_moved").eqNullSafe(F.col("_kept")), "left_semi"), "doubtful-ids")
    if both.isEmpty():
        return main
    rows = with_ids(docs, id_col, both)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    rows = rows.select(*[F.col(f"`{c}`") for c in docs.columns], full_text(text_col).alias("_text")).mapInArrow(_keyed_rows, f"{columns}, _set_key long")
    rows = stored(rows, "doubtful")
    wordless = rows.where("_set_key IS NULL").select(*docs.columns)
    rows = rows.join(kept, F.col(id_col).eqNullSafe(F.col("_kept")) & (F.col("_set_key") == F.col("_kept_key")), "left_semi")
    nth = Window.partitionBy(id_col, "_set_key").orderBy(*[F.col(f"`{c}`").cast("string") for c in docs.columns])
    one = rows.withColumn("_nth", F.row_number().over(nth)).where("_nth = 1").select(*docs.columns)
    return main.unionByName(wordless).unionByName(one)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))
