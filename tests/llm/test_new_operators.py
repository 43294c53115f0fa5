"""Sharding, fill-in-the-middle and whitening against brute-force versions; bounds of the toxicity sample and of what exact dedup shuffles."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.llm import exact_dedup, fill_middle, near_dedup, sharding, suspects, toxicity, whitening

SCHEMA = "doc_id long, text string, source string, shard int, n string, form int, fraction string, cut string"
TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 9, "n", 1, "f", "c") for i, t, s in rows], SCHEMA).repartition(3)


def rows_of(seed=0, n=400):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé漢<P>S") for _ in range(rng.randint(1, 6)))
    sep = lambda: rng.choice([" ", "  ", "\n", "\t \x0b", " ", "  "])
    text = lambda k: "".join(word() + sep() for _ in range(rng.randint(0, k)))
    rows = [(i, text(12), "hot" if i % 3 else f"s{i % 17}") for i in range(n)]
    rows += [(n + 1, None, None), (n + 2, "", "s1"), (n + 3, "  \n ", None), (n + 4, " lead", "s2"), (n + 5, "tail \n", "s2"), (n + 6, "x " * 40_000, "hot"), (n + 7, "漢" * 70_000, "hot")]
    rows += [(5, rows[5][1], rows[5][2])] * 3 + [(None, "a b", "s3"), (None, None, None), (None, "a b", "s3")]
    return rows + [(n + 10 + k, t, "s4") for k, t in enumerate(("has <P> in it", "has <M>", "a <S", "P> b", "one", "<", "<<P", " "))]


# ---- sharding


@pytest.mark.parametrize("count", [24, 5])
def test_shards_hold_the_mixture(spark, count):
    rows = rows_of()
    got = sharding.shards(frame(spark, rows), shards=count).collect()
    data = lambda t: (t or "").encode()
    assert sorted((str(r.doc_id), str(r.source), r.size, r.text_crc32) for r in got) == sorted((str(i), str(s), len(data(t)) + 8, zlib.crc32(data(t))) for i, t, s in rows)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(count)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    totals, each = Counter(s for _, _, s in rows), Counter((r.shard, r.source) for r in got)
    assert all(abs(each[k, s] - totals[s] / count) <= 2 + 2 * len(totals) * totals[s] / len(rows) for k in range(count) for s in totals)
    hot = [each[k, "hot"] for k in range(count)]
    assert max(hot) - min(hot) <= 6


def brute_shards(rows, count, seed=42):
    key = lambda *p: int(hashlib.md5(":".join([str(seed), *map(str, p)]).encode()).hexdigest()[:15], 16)
    by_source = defaultdict(list)
    for i, t, s in rows:
        b = (t or "").encode()
        by_source["" if s is None else "=" + s].append((key(i, zlib.crc32(b), len(b) + 8), str(i), zlib.crc32(b), len(b) + 8))
    order = []
    for stratum, own in by_source.items():
        phase = ((key(stratum) >> 30) + 0.5) / 2**30
        order += [((r - phase) / len(own), stratum, *x) for r, x in enumerate(sorted(own), 1)]
    n = len(rows)
    return sorted((x[3], x[4], p * count // n, p - -(-(p * count // n) * n // count)) for p, x in enumerate(sorted(order)))


def test_shards_equal_brute_force_wherever_rows_lie(spark):
    rows = [r for r in rows_of() if r[0] is not None]
    want = brute_shards(rows, 24)
    for parts in (1, 7):
        got = sharding.shards(frame(spark, rows).repartition(parts)).collect()
        assert sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in got) == want


def test_many_sources_of_one_row_and_small_tables(spark):
    rows = [(i, "t", f"s{i}") for i in range(600)]
    got = sharding.shards(frame(spark, rows)).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [25] * 24
    assert sharding.shards(frame(spark, rows).limit(0)).collect() == []
    few = sharding.shards(frame(spark, rows[:3])).collect()
    assert [r.slot for r in few] == [0, 0, 0] and len({r.shard for r in few}) == 3


def test_sharding_reads_no_text_after_the_first_pass_and_no_python(spark):
    plan = sharding.shards(frame(spark, rows_of()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "text#" not in plan and "CartesianProduct" not in plan


# ---- fill in the middle


def brute_fim(i, t, unit="token"):
    t = t or ""
    parts = TOKEN.findall(t) if unit == "token" else list(t)
    n = len(parts)
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 50:
        return n, "plain", None, None, t
    if h[3] % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("unit", ["token", "char"])
def test_fill_in_middle(spark, unit):
    rows = rows_of()
    made = fill_middle.restore(fill_middle.fill_in_middle(frame(spark, rows), unit=unit))
    assert made.columns == ["doc_id", "text", "source", "shard", "fraction", "cut", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = made.collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(((i, *brute_fim(i, t, unit)) for i, t, _ in rows), key=key)
    assert all(r.restored == (r.text or "") for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(frame(spark, rows).limit(0)).collect() == []


def test_runs_in_slices_and_at_edges():
    texts = ["", " a", "b  c ", "", "é x", "   ", "z", ""]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    for unit, count in (("token", lambda t: len(TOKEN.findall(t))), ("char", len)):
        runs = fill_middle.encode_runs(np.frombuffer(data, np.uint8), offsets, unit)
        assert np.diff(runs.row_units).tolist() == [count(t) for t in texts]
        assert np.diff(runs.row_points).tolist() == [len(t) for t in texts]


def test_shares_of_forms(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    got = {r.form: r["count"] for r in fill_middle.fill_in_middle(docs, percent=90, spm_percent=25).groupBy("form").count().collect()}
    assert abs(got["plain"] - 400) < 90 and abs(got["spm"] - 900) < 120 and abs(got["psm"] - 2700) < 150
    assert fill_middle.fill_in_middle(docs, percent=0).where("form <> 'plain'").isEmpty()


# ---- whitening

VECTORS = "vec_id long, embedding array<float>, label int, whitened string, component int"


def vectors_of(n=300, d=12, seed=3):
    rng = np.random.default_rng(seed)
    x = (rng.normal(0, 1, (n, d)) @ rng.normal(0, 0.3, (d, d))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1001, [None] * d), (1002, [float("nan"), *[0.0] * (d - 1)]), (1003, [float("inf"), *[0.0] * (d - 1)]), (1004, [*[0.0] * (d - 1), None])]
    return rows + bad + [(None, rows[3][1]), (4, rows[4][1]), (4, rows[4][1])], np.vstack((x, x[3], x[4], x[4]))


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "w", 5) for i, v in rows], VECTORS).repartition(3)


def test_whitening(spark):
    rows, fit = vectors_of()
    done = whitening.whiten(vector_frame(spark, rows))
    got = whitening.by_component(done).collect()
    x = np.floor(1024 * fit.astype(float)).astype(int) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    assert {r.n for r in got} == {n} and len(got) == 8 * n and {r.component for r in got} == set(range(1, 9))
    by_id = defaultdict(dict)
    for r in got:
        by_id[r.vec_id][r.component] = r
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    for k in range(8):
        want = centred @ directions[:, k] / np.sqrt(values[k])
        found = np.array([by_id[i][k + 1].whitened for i in range(300)])
        sign = np.sign(found[0] * want[0])
        assert np.allclose(found, sign * want[:300], atol=1e-8)
        assert by_id[0][k + 1].explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
    assert [by_id[i][1].deviation for i in range(300)] == [int(((n * v - sums) ** 2).sum()) for v in x[:300]]
    assert set(done.columns) == {"vec_id", "embedding", "label", "component", "n", "deviation", "whitened", "explained", "identity_error"}


def test_whitening_of_flat_short_and_mixed_vectors(spark):
    flat = whitening.by_component(whitening.whiten(vector_frame(spark, [(i, [float(i % 5), 2.0, float(i % 3)]) for i in range(30)]))).collect()
    assert len(flat) == 90 and {r.whitened for r in flat if r.component == 3} == {None} and all(r.identity_error < 1e-9 for r in flat)
    same = whitening.by_component(whitening.whiten(vector_frame(spark, [(1, [1.0, 2.0])] * 4))).collect()
    assert len(same) == 8 and {(r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(0, None, 0.0, 0.0)}
    mixed = whitening.whiten(vector_frame(spark, [(i, [float(i), float(i * i)]) for i in range(9)] + [(9, [1.0]), (10, [])])).collect()
    assert sorted(r.vec_id for r in mixed if r.whitened is None) == [9, 10] and {r.n for r in mixed} == {9}
    assert whitening.whiten(vector_frame(spark, [])).collect() == []
    assert whitening.whiten(vector_frame(spark, [(1, None)])).collect() == []


def test_a_deviation_beyond_64_bits_is_an_error():
    m = whitening.Whitening(4, np.array([0, 0]), np.eye(2), np.ones(2), 2.0)
    assert m.deviations(np.array([[3 * 10**8, 0]])).tolist() == [(12 * 10**8) ** 2]
    with pytest.raises(OverflowError):
        m.deviations(np.array([[10**9, 0]]))


# ---- the bound of the toxicity sample


def test_training_sample_is_bounded(spark):
    rows = [(i, f"text {i}") for i in range(60)] + [(7, "same id " * k) for k in range(1, 40)] + [(8, "z" * 400_000)] * 3 + [(9, "text 9")] * 50 + [(70, "y" * 400_000), (71, None), (None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(60), 70, 71]] + [(None, 1)], "doc_id long, toxic int")
    every = toxicity.training_sample(docs, labels, per_class=1000).collect()
    assert sorted(r["__pick"] for r in every) == list(range(60)) and {r.weight for r in every} == {1.0}
    assert max(len(r.text) for r in every) <= 20_000
    few = toxicity.training_sample(docs, labels, per_class=20).collect()
    assert Counter(r.toxic for r in few) == {0: 20, 1: 20} and len({r["__pick"] for r in few}) == 40 and {r.weight for r in few} == {1.5}
    assert toxicity.training_sample(docs, labels, per_class=20).orderBy("__pick").collect() == sorted(few, key=lambda r: r["__pick"])
    assert max(len(r.text) for r in toxicity.training_sample(docs, labels, sample_chars=6).collect()) <= 6


# ---- what exact dedup shuffles


def test_only_texts_that_pass_the_filter_are_shuffled(spark):
    docs = spark.createDataFrame([(i, f"text {i if i % 10 else 0} " + "x" * 50) for i in range(5000)], "doc_id long, norm string")
    keyed = docs.select("doc_id", "norm", F.xxhash64("norm").alias("fp"))
    found, words = suspects.suspect_filter(keyed.where("doc_id % 10 = 0").select("fp"))
    passed = suspects.passing(keyed, found, words)
    ids = {r.doc_id for r in passed.collect()}
    assert {i for i in range(0, 5000, 10)} <= ids
    assert words == 1 and suspects.suspect_filter(keyed.select("fp"))[1] == 4501 // 2
    several, words = suspects.suspect_filter(keyed.where("doc_id % 10 = 1").select("fp"))
    assert len({r.doc_id for r in suspects.passing(keyed, several, words).collect()} - set(range(1, 5000, 10))) < 60
    assert suspects.passing(keyed, *suspects.suspect_filter(keyed.select("fp"), most_words=3)).count() == 5000
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tree = suspects.passing(keyed, found, words)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in tree and "SortMergeJoin" not in tree


def planned(spark, of):
    """Physical plans, as text, of what ``of`` runs where nothing is broadcast but by hint."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    seen = []
    kept = {m: getattr(m, "checkpointed") for m in (exact_dedup, near_dedup)}
    try:
        for m, f in kept.items():
            setattr(m, "checkpointed", lambda df, f=f: seen.append(df._jdf.queryExecution().executedPlan().toString()) or f(df))
        seen.append(of()._jdf.queryExecution().executedPlan().toString())
    finally:
        for m, f in kept.items():
            setattr(m, "checkpointed", f)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    return seen


def exchanged_texts(plan):
    """Exchanges below which a scan of the texts lies without the filter's join in between."""
    lines = plan.splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    bad = []
    for k, line in enumerate(lines):
        if re.search(r"\bExchange ", line):
            path = []
            for x in lines[k + 1 :]:
                if depth(x) <= depth(line):
                    break
                path.append(x)
            below = "\n".join(path)
            if "text#" in below and re.search("Scan parquet", below) and "BroadcastHashJoin" not in below and "norm#" in below:
                bad.append(line.strip()[:120])
    return bad


@pytest.mark.parametrize("of", [exact_dedup.exact_duplicates, near_dedup.near_duplicates])
def test_no_text_is_shuffled_before_the_filter(spark, tmp_path, of):
    spark.createDataFrame([(i, f"some words of text {i % 40} and more {i % 7}") for i in range(200)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    plans = planned(spark, lambda: of(spark.read.parquet(str(tmp_path / "d"))))
    assert any("BroadcastHashJoin" in p and "Scan parquet" in p for p in plans)
    assert [x for p in plans for x in exchanged_texts(p)] == []


# ---- templates


def template_texts(n, words=900, own=26, seed=3):
    """Texts of one template with words of their own at places of their own: pairs at a similarity of about 0.845, near but not near enough."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for k in range(n):
        text = list(base)
        for j in rng.sample(range(5, words - 5, 4), own):
            text[j] = f"own{k}x{j}"
        out.append((k, " ".join(text)))
    return out


def pairs_tested(spark, rows, monkeypatch, wide):
    """Ordered pairs of nodes in different components that meet in the second round's blocks, and the result."""
    seen = []
    plain = near_dedup._open_blocks

    def counted(members, *args):
        members = near_dedup.checkpointed(members)
        sizes = members.groupBy("bucket").agg(F.first("most").alias("m"), F.first("rest").alias("r")).select((2 * F.col("m") * F.col("r") + F.col("r") * F.col("r")).alias("pairs")).agg(F.sum("pairs")).first()[0]
        seen.append(sizes or 0)
        return plain(members, *args)

    monkeypatch.setattr(near_dedup, "_open_blocks", counted)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), wide=wide).collect()
    monkeypatch.setattr(near_dedup, "_open_blocks", plain)
    return sum(seen), {r.doc_id: r.component_id for r in got}


def test_templates_below_the_threshold_hardly_meet(spark, monkeypatch):
    rows = template_texts(250)
    grams = [{" ".join(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for _, t in rows)]
    near = [100 * len(a & b) >= 85 * len(a | b) for k, a in enumerate(grams) for b in grams[:k]]
    assert not any(near)
    copy = rows[7][1].replace("own7x", "mine7x", 3)
    rows.append((1000, copy))
    without, plain = pairs_tested(spark, rows, monkeypatch, 10**9)
    cut, finer = pairs_tested(spark, rows, monkeypatch, 30)
    assert plain == finer == {**{k: k for k, _ in rows}, 1000: 7}
    assert cut < without / 10


# ---- owners that a table must name


def test_secrets_need_to_know_whose_a_row_is(spark):
    from pyspark.errors import AnalysisException

    from barlab.llm import secrets

    docs = spark.createDataFrame([(1, "password=abcdefgh1")], "doc_id long, text string")
    with pytest.raises(AnalysisException):
        secrets.redact(docs).collect()
    got = secrets.redact(docs, owner=F.lit("me"), repo=F.lit("mine")).first()
    assert got.text == "[SECRET]"
