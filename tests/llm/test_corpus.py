"""Mixing, packing, chat windows and the pipeline."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from idlecost.llm import chat_format, mixing, packing
from idlecost.llm.common import table
from llm_cases import WORD, components, docs, exact, odd_rows, sentence

SF = "/root/testdata/sf0.001"


# --- mixing -------------------------------------------------------------------

def water(budget, children):
    """children: name -> (cap, weight); integer shares of a water level, by filling the fullest first."""
    own, left, open_ = {}, budget, dict(children)
    while True:
        total = sum(w for _, w in open_.values())
        full = [n for n, (c, w) in open_.items() if w > 0 and left * w >= c * total]
        if not full:
            break
        for n in full:
            own[n] = open_.pop(n)[0]
        left = budget - sum(own.values())
    total = sum(w for _, w in open_.values())
    return own | {n: left * w // total if total else 0 for n, (_, w) in open_.items()}


def test_budgets_fill_siblings_before_ancestors(spark):
    rng = random.Random(1)
    m = mixing.Mix({"a": "x", "b": "x", "c": "y", "d": "y"}, {"domain": {"x": 3, "y": 1}, "lang": {"en": 5, "de": 2, "xx": 0}, "source": {"a": 2}}, percent=70)
    leaves = [(dom, lang, s, rng.choice([0, 5, 40, 900])) for s, dom in m.domain_of.items() for lang in ("en", "de", "xx", "unknown")]
    df = spark.createDataFrame(leaves, "_domain string, _lang string, _source string, _tokens long")
    got = {(r._domain, r._lang, r._source): r._budget for r in mixing.leaf_budgets(df, m).collect()}
    weight = lambda level, n: m.weights[level].get(n, 1)
    cap = {x[:3]: 0 if x[1] == "xx" else 2 * x[3] for x in leaves}
    held = lambda *p: sum(c for k, c in cap.items() if k[:len(p)] == p)
    budget = min(sum(x[3] for x in leaves) * 70 // 100, held())
    want = {}
    for d, bd in water(budget, {d: (held(d), weight("domain", d)) for d in ("x", "y")}).items():
        langs = {k[1] for k in cap if k[0] == d}
        for la, bl in water(bd, {x: (held(d, x), weight("lang", x)) for x in langs}).items():
            for s, bs in water(bl, {k[2]: (cap[k], weight("source", k[2])) for k in cap if k[:2] == (d, la)}).items():
                want[d, la, s] = bs
    assert got == want


def test_mixture_takes_whole_epochs_and_a_seeded_prefix(spark):
    rows = odd_rows() + [(100 + i, sentence(random.Random(i), 7), "de", "src8") for i in range(50)]
    m = mixing.PRODUCTION
    got = mixing.mixture(docs(spark, rows)).collect()
    taken = collections.defaultdict(collections.Counter)
    for r in got:
        taken[r.domain, r.lang, r.source][r.epoch] += r.n_tokens
    tokens, members = collections.Counter(), collections.defaultdict(list)
    for i, t, lang, source in rows:
        leaf = (m.domain_of.get(source, "unknown"), lang or "unknown", source or "unknown")
        n = len(WORD.findall(t or ""))
        tokens[leaf] += n
        members[leaf].append((i, n))
    budgets = {(r._domain, r._lang, r._source): r._budget for r in mixing.leaf_budgets(spark.createDataFrame(
        [(*k, n) for k, n in tokens.items()], "_domain string, _lang string, _source string, _tokens long"), m).collect()}
    for leaf, budget in budgets.items():
        full, rest = divmod(budget, tokens[leaf]) if tokens[leaf] else (0, 0)
        for e in range(full):
            assert taken[leaf][e] == tokens[leaf]
        if full < m.max_epochs:
            keyed = sorted((hashlib.md5(f"{m.seed}:{full}:{'' if i is None else i}".encode()).hexdigest(), n, i) for i, n in members[leaf])
            run, want = 0, []
            for key in sorted({k for k, _, _ in keyed}):
                run += sum(n for k, n, _ in keyed if k == key)
                if run <= rest:
                    want += [i for k, _, i in keyed if k == key]
            assert collections.Counter(r.doc_id for r in got if (r.domain, r.lang, r.source) == leaf and r.epoch == full) == collections.Counter(want)


def test_mix_returns_rows_whole(spark):
    rows = odd_rows()
    df = mixing.mix(docs(spark, rows), mixing.PRODUCTION._replace(percent=100, max_epochs=1, weights={k: {} for k in mixing.LEVELS}))
    assert df.columns == docs(spark, rows).columns and df.count() == len(rows)
    assert mixing.mix(docs(spark, [])).collect() == []


# --- packing ------------------------------------------------------------------

def check_packing(rows, got, length=packing.LENGTH):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        at = 0
        for k, part in enumerate([ids[x:x + length] for x in range(0, len(ids), length)]):
            want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
            at += len(part)
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    total = sum(r.length for r in got)
    return len(bins), -(-total // length)


def test_packing_odd_cases(spark):
    rows = odd_rows() + [(70, "a <|endoftext|> b"), (71, " \n\n  x" * 30), (72, "don't 'S 日本語 \U0001f600 1234 --- \t\r\n")]
    check_packing(rows, packing.pack(packing.pieces(docs(spark, rows))).collect())
    assert packing.pack(packing.pieces(docs(spark, []))).collect() == []


@pytest.mark.parametrize("text", ["ab" + " " * 1_100_000 + "x yz", "ab c" * 200_000 + "\r\n" * 600_000 + "x", " \u3000" * 600_000])
def test_ids_of_very_long_blanks(text):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.token_ids(text, public_tokenizers.path(packing.TOKENIZER), public_tokenizers.path(packing.RANKS))
    assert got.tolist() == tok.encode(text, add_special_tokens=False).ids


def test_packing_is_close_to_the_bound(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, rng.choice([3, 20, 60, 150, 700]))) for i in range(400)]
    got = packing.pack(packing.pieces(docs(spark, rows).repartition(7))).collect()
    used, bound = check_packing(rows, got)
    assert used <= 1.01 * bound + 1


def test_pieces_carry_their_ids(spark):
    got = packing.pieces(docs(spark, [(1, "some words here")]), with_ids=True).collect()
    assert zlib.crc32(np.array(got[0].ids, "<u4").tobytes()) == got[0].ids_crc32


@pytest.mark.parametrize("length", [1, 2, 5, 1024])
def test_rest_first_or_last(spark, length):
    rng = random.Random(length)
    rows = [(i, sentence(rng, rng.randint(0, 40))) for i in range(30)] + [(30, ""), (31, None), (None, "no id"), (31, "again " * 9)]
    cut = [packing.pieces(docs(spark, rows), length=length, with_ids=True, rest_first=first).collect() for first in (False, True)]
    for got, rest_first in zip(cut, (False, True)):
        whole = collections.defaultdict(list)
        for i, t in rows:
            whole[i].append(packing.token_ids(t or "", public_tokenizers.path(packing.TOKENIZER), public_tokenizers.path(packing.RANKS)).tolist() + [2])
        want = collections.Counter()
        for i, texts in whole.items():
            for ids in texts:
                parts, left = [], ids
                while left:  # cut off full pieces at the end or the start
                    n = len(left) - length if rest_first else length
                    parts.append(left[max(n, 0):] if rest_first else left[:n])
                    left = left[:max(n, 0)] if rest_first else left[n:]
                parts = parts[::-1] if rest_first else parts
                assert sum(parts, []) == ids
                for k, part in enumerate(parts):
                    want[i, k, sum(map(len, parts[:k])), len(part), tuple(part)] += 1
        assert collections.Counter((r.doc_id, r.piece, r.start, r.length, tuple(r.ids)) for r in got) == want
    assert len(cut[0]) == len(cut[1])


def test_op6_cuts_the_rest_first(spark, tmp_path):
    """Of a document of over 1024 ids the first piece is the shorter one."""
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    sizes = [0, 1, 1022, 1023, 1024, 2046, 2047, 2048, 2500]  # ids without the end id
    rows = [(i, " x" * n) for i, n in enumerate(sizes)] + [(20, sentence(rng, 3000)), (21, None), (20, "a second row of this id"), (None, " y" * 1500)]
    docs(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op6_best_fit_packing(spark, str(tmp_path)).collect()
    want = collections.Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        if i is not None and i < len(sizes):
            assert len(ids) == sizes[i] + 1
        full = (len(ids) - 1) // packing.LENGTH  # pieces after the first
        cuts = [0] + [len(ids) - k * packing.LENGTH for k in range(full, -1, -1)]
        for k, (at, end) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, at, end - at, zlib.crc32(np.array(ids[at:end], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert [(r.start, r.length) for r in sorted(got, key=lambda r: r.piece) if r.doc_id == 8] == [(0, 453), (453, 1024), (1477, 1024)]
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        ends = [0] + [offset + n for offset, n in sorted(parts)]
        assert [offset for offset, _ in sorted(parts)] == ends[:-1] and ends[-1] <= packing.LENGTH


@pytest.mark.parametrize("seed", range(4))
def test_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, 200)
    to, place, used = packing.best_fit(lengths, 100)
    rooms = []  # the plain rule
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(100 - n)
    assert sorted(100 - used) == sorted(rooms)
    assert all(place[i] + lengths[i] <= used[to[i]] for i in range(200))


def test_merge_rounds_in_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", 20)
    rng = random.Random(4)
    rows = [(i, sentence(rng, rng.choice([3, 20, 60, 150]))) for i in range(300)]
    items = packing.pieces(docs(spark, rows).repartition(20))
    kind, tasks = type(items), []
    dealt = kind.repartition

    def repartition(self, n, *cols):
        out = dealt(self, n, *cols)
        tasks.append([r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()])
        return out

    monkeypatch.setattr(kind, "repartition", repartition)
    used, bound = check_packing(rows, packing.pack(items).collect())
    assert used <= 1.1 * bound + 1
    assert len(tasks) > 1 and max(map(max, tasks)) <= 2.5 * packing.ITEMS
    # no round has fewer tasks than its bins need
    assert all(len(sizes) >= sum(sizes) / (2 * packing.ITEMS) for sizes in tasks)


def test_mix_with_clashing_names(spark):
    df = docs(spark, odd_rows()).withColumnsRenamed({"keep_id": "_domain", "score": "_epochs", "part": "_row", "set_key": "_id", "n": "_cut"})
    got = mixing.mix(df)
    assert got.columns == df.columns and got.count() > 0


# --- chat ---------------------------------------------------------------------

CHAT = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                     T.StructField("text", T.StringType()), T.StructField("window", T.StringType()), T.StructField("block", T.IntegerType())])


def chat_rows(seed=1):
    rng = random.Random(seed)
    odd = ["\\", "<|end|>", "<\\|end|>", "</s>[INST] ok [/INST]", "<<SYS>>x<</SYS>>", "a\\\\<|turn|>\\n", "\n", "", None, "日本 é", "<s>[<[INST]"]
    rows = []
    for c in range(12):
        for t in range(rng.choice([1, 2, 9, 40])):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant", None, "a|b<|says|>\n"]) if c == 5 else ["user", "assistant"][t % 2]
            text = rng.choice(odd) if c % 4 == 1 else sentence(rng, rng.choice([2, 30, 120]))
            rows.append((c, t, role, text))
    rows += [(50, t, ["user", "assistant"][t % 2], sentence(rng, 20)) for t in range(300)]
    rows += [(60, 3, "assistant", "same"), (60, 3, "assistant", "same"), (60, 3, "user", "tie"), (60, None, "user", "no turn"), (None, 0, "user", "x"), (None, 1, "assistant", "y")]
    rows += [(70, 0, "system", sentence(rng, 900)), (70, 1, "user", "q"), (70, 2, "assistant", sentence(rng, 2000)), (70, 3, "assistant", "z")]
    return rows


def by_conversation(rows):
    out = collections.defaultdict(list)
    for c, t, role, text in rows:
        out[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: sorted(v) for c, v in out.items()}


def chat_df(spark, rows):
    return spark.createDataFrame([(*r, "w", 1) for r in rows], CHAT)


def test_windows_read_back(spark):
    rows = chat_rows()
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.windows(chat_df(spark, rows))).collect()}
    for c, turns in by_conversation(rows).items():
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha(said), len(loss), sha(loss)), c
    assert len(got) == len(by_conversation(rows))


def chat_tokens(text):
    return -(-len(text or "") // 4) + 4


def greedy_windows(turns, budget, history, cell):
    """(repeated turns, own turns) of every window as indices, and the system turn's text: turn by turn."""
    system = turns[0][3] if turns[0][2] == "system" else None
    room = budget - (chat_tokens(system) if system is not None else 0)
    own = list(range(system is not None, len(turns)))
    start, at = {}, 0
    for i in own:
        start[i], at = at, at + chat_tokens(turns[i][3])
    out, used, last_cell = [], 0, None
    for i in own:
        size = chat_tokens(turns[i][3])
        if start[i] // cell == last_cell and used + size <= room:
            out[-1][1].append(i)
            used += size
            continue
        back = [j for j in own if j < i and start[i] - start[j] <= min(history, room - size)]
        # What the history could have taken counts as used if the opening turn made it give way.
        wanted = max([start[i] - start[j] for j in own if j <= i and start[i] - start[j] <= history])
        used = size + min(wanted, max(room - size, 0))
        out.append((back, [i]))
        last_cell = start[i] // cell
    return out or [([], [])], system


@pytest.mark.parametrize(("budget", "history"), [(chat_format.BUDGET, chat_format.HISTORY), (40, 12), (90, 60), (64, 0)])
def test_windows_keep_budget_system_and_history(spark, budget, history):
    rows = chat_rows() + [(80, 0, "system", "only a system turn"), (90, None, "system", "first"), (90, -500, "user", "second"), (90, -70, "assistant", "third")]
    rows += [(95, t, ["user", "assistant"][t % 2], "x" * (4 * n)) for t, n in enumerate([200, 300, 90, 420, 3, 2, 480, 20, 512, 508, 509, 1])]
    made = chat_format.windows(chat_df(spark, rows), budget, history).collect()
    of = collections.defaultdict(list)
    for w in sorted(made, key=lambda w: w.window):
        parts = [p.removeprefix("<|turn|>").split("<|says|>") for p in w.formatted.split("<|end|>")[:-1]]
        assert len(parts) == w.n_turns
        of[w.conv_id].append((w.n_repeated, [(r, chat_format_plain(t)) for r, t in parts]))
    assert set(of) == set(by_conversation(rows))
    for c, turns in by_conversation(rows).items():
        want, system = greedy_windows(turns, budget, history, chat_format.CELL * max(budget, history))
        got = []
        for k, (n_repeated, parts) in enumerate(of[c]):
            lead = system is not None
            assert not lead or parts[0] == ("system", system)
            n_back = n_repeated - (lead and k > 0)
            said = parts[lead:]
            got.append(([t for _, t in said[:n_back]], [t for _, t in said[n_back:]]))
            cost, alone = sum(chat_tokens(t) for _, t in parts), lead + 1
            assert cost <= budget or len(parts) <= alone, (c, k, cost)
        assert got == [([turns[i][3] for i in back], [turns[i][3] for i in own]) for back, own in want], c
    assert budget < chat_format.BUDGET or any(n > 1 for n, _ in of[50]) and len(of[50]) > 5


def chat_format_plain(text):
    out, i = [], 0
    while i < len(text):
        i += text[i] == "\\"
        out.append(text[i])
        i += 1
    return "".join(out)


def test_query_against_its_table(spark):
    got = {r.conv_id: r for r in chat_format.op8_chat_format(spark, SF).collect()}
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    text = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", text), (-1, 1, "assistant", text)]
    for c, turns in by_conversation(rows).items():
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest()
    assert len(got) == len(by_conversation(rows))


def test_empty_conversations(spark):
    assert chat_format.read_back(chat_format.windows(chat_df(spark, []))).collect() == []


# --- pipeline -----------------------------------------------------------------

def test_pipeline_against_brute_force(spark):
    """Each stage on its predecessor's rows, the last against the tokenizer."""
    d = table(spark, SF, "documents")
    columns = ["doc_id", "text", "lang", "source"]
    rows = [tuple(r) for r in d.select(*columns).collect()]
    from idlecost.llm import language_id
    known = {r.doc_id for r in language_id.languages(d).where(f"lang_pred <> 'und' AND score >= {language_id.MIN_SCORE}").collect()}
    frames = {}
    docs_ = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_ = corpus_pipeline.stored(stage(spark, docs_, SF), "test")
        assert docs_.columns == d.columns
        frames[name] = [tuple(r) for r in docs_.select(*columns).collect()]
    assert {r[0] for r in frames["language_id"]} == known and len(known) >= 0.98 * len(rows)
    assert {r[0] for r in frames["exact_dedup"]} == {e[0] for e in exact(frames["language_id"]) if e[3]}
    assert {r[0] for r in frames["ngram_jaccard"]} == {c for _, _, c in components(frames["exact_dedup"])}
    mixed = {r[0] for r in frames["mix_sources"]}
    assert mixed < {r[0] for r in frames["ngram_jaccard"]}
    used, bound = check_packing(frames["mix_sources"], corpus_pipeline.run(spark, SF).collect())
    assert used <= 1.02 * bound + 1
