"""Source divergence, whitening and sharding against brute force and in hard cases."""
import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayspark.llm import divergence, repeats, sharding, toxicity, whitening

SF = "/root/testdata/sf0.001"


def plain_audit(rows, least, top):
    """The audit of (text, lang, source) rows, term by term over dense tables."""
    docs = [(lang or "", source or "", divergence.TERM.findall((text or "").encode().lower())) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        standing = collections.Counter(t for _, _, w in own for t in set(w))
        kept = sorted(t for t, n in standing.items() if n >= least)
        sources = sorted({s for _, s, _ in own}, key=str.encode)
        counts = {s: collections.Counter(t for _, x, w in own if x == s for t in w) for s in sources}
        whole = sum(counts.values(), collections.Counter())
        def rates(c):
            total = sum(c[k] for k in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}
        p, q = {s: rates(counts[s]) for s in sources}, rates(whole)
        for s in sources:
            far = sorted(((-sum(abs(p[s][t] - p[x][t]) for t in kept), x.encode()) for x in sources if x != s))
            telling = sorted((q[t] - p[s][t], t) for t in kept if counts[s][t] and p[s][t] > q[t])
            out += [(lang, s, part, i.decode(), -v, n) for part, items in (("pair", far), ("term", telling[:top])) for n, (v, i) in enumerate(items, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_audit(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    for least, top in ((30, 50), (2, 7)):
        assert rows_of(divergence.audit(docs, least_docs=least, top=top)) == plain_audit(rows, least, top)


def test_audit_hard(spark, monkeypatch):
    draw = random.Random(4)
    words = ["Foo", "fOO", "é", "É", "b2b", "x-y", "日本", "the", "the", "a\x00b", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))]
    rows = [(" ".join(draw.choice(words) for _ in range(draw.randint(0, 90))), draw.choice(["en", "de", None, ""]), draw.choice(["a", "b", "c", None, "é", "Z"])) for _ in range(150)]
    rows += [(None, "en", "a"), ("", "xx", "only"), ("123", "yy", "a"), ("9", "yy", "b"), rows[0], rows[0], ("the " * 5000 + "end", "en", "b")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n long, term string").repartition(5)
    want = {least: plain_audit(rows, least, 50) for least in (1, 3, 30)}
    for least in want:
        assert rows_of(divergence.audit(df, least_docs=least)) == want[least]
    monkeypatch.setattr(divergence, "STRETCH", 50), monkeypatch.setattr(divergence, "ENTRIES", 20)
    pieces = [t for t, *_ in rows if t]
    assert all(b"".join(divergence.stretches(t.encode())) == t.encode() for t in pieces)
    assert [w for p in divergence.stretches(rows[-1][0].encode()) for w in divergence.TERM.findall(p)] == [b"the"] * 5000 + [b"end"]
    assert divergence.audit(df.limit(0)).count() == 0


def test_tree_is_shared():
    """Nodes that rows share are paid once: the sums are those of all rows, from fewer node-ancestor pairs, whatever is in memory at a time."""
    import pyarrow as pa
    draw = random.Random(2)
    rows = sorted({tuple(sorted({s: draw.randint(1, 2) for s in range(1, 7) if draw.random() < 0.8}.items())) for _ in range(400)} - {()})
    paths = [[{"number": s, "n": n, "p": 10 * n + s, "absent": s} for s, n in r] for r in rows]
    times = [draw.randint(1, 5) for _ in rows]
    kind = pa.list_(pa.struct([("number", pa.int32()), ("n", pa.int64()), ("p", pa.int64()), ("absent", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(rows)), pa.array(paths, kind), pa.array(times)], names=["lang", "path", "times"])
    want = collections.Counter()
    for path, m in zip(paths, times):
        for k, low in enumerate(path):
            for up in path[:k]:
                want[up["number"], low["number"]] += m * (abs(up["p"] - low["p"]) - abs(up["p"] - low["absent"]) - abs(up["absent"] - low["p"]) + abs(up["absent"] - low["absent"]))
    for part in ([batch], [batch.slice(0, 37), batch.slice(37)]):
        got = collections.Counter()
        for out in divergence.tree_sums(iter(part)):
            for r in out.to_pylist():
                got[r["a"], r["b"]] += r["both"]
        assert got == want
    nodes = {r[:k] for r in rows for k in range(1, len(r) + 1)}
    assert sum(len(n) - 1 for n in nodes) < 0.7 * sum(len(r) * (len(r) - 1) // 2 for r in rows)


def plain_whitening(vectors, most=16):
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    listed = sorted(set(map(tuple, x)))
    n, sums = len(listed), [sum(c) for c in zip(*listed)]
    centred = (np.array(listed, object) * n - np.array(sums, object)).astype(float) / n
    cov = centred.T @ centred / n
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1][:most], vecs[:, ::-1][:, :most]
    real = values > 1e-10 * values[0]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    y = ((np.array(x, object) * n - np.array(sums, object)).astype(float) / n) @ vecs[:, real] / np.sqrt(values[real])
    return n, deviation, y, values[real] / np.trace(cov)


def check_whitening(df, rows):
    got = df.collect()
    n, deviation, y, share = plain_whitening([v for _, v in rows])
    k = y.shape[1]
    assert len(got) == len(rows) * k and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, k + 1))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error <= 1e-6
    at = {i: row for row, (i, _) in enumerate(rows)}
    white = np.zeros_like(y)
    for r in got:
        assert r.deviation == deviation[at[r.vec_id]] and abs(r.explained - share[r.component - 1]) <= 1e-9 * share[r.component - 1]
        white[at[r.vec_id], r.component - 1] = r.whitened
    signs = np.sign((white * y).sum(axis=0))
    assert np.abs(white * signs - y).max() < 1e-7


def test_whitening(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    check_whitening(whitening.whiten(table), [(r.vec_id, r.embedding) for r in table.collect()])


def test_whitening_hard(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in draw.normal(0, s, 5)]) for i, s in enumerate([1.0] * 40 + [600.0] * 5 + [1e8] * 3)]
    rows += [(100, rows[0][1]), (101, rows[0][1])]
    bad = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [1.0, float("nan"), 1.0, 1.0, 1.0]), (203, [float("inf")] * 5), (204, []), (205, [1.0, 2.0])]
    schema = "vec_id long, embedding array<float>, n long, size int, packed string"
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows + bad], schema).repartition(3)
    small = [r for r in rows if max(map(abs, r[1])) < 1e4]
    check_whitening(whitening.whiten(df.filter("vec_id < 45 or vec_id >= 100")), small)
    out = whitening.whiten(df).collect()
    n, deviation, _, _ = plain_whitening([v for _, v in rows])
    assert {r.vec_id: r.deviation for r in out} == {i: v if v < 1 << 63 else None for (i, _), v in zip(rows, deviation)} and out[0].n == n == 48
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.filter("vec_id in (0, 100, 200)")).count() == 0
    flat = spark.createDataFrame([(i, [float(i % 3), 2.0 * (i % 3), 5.0]) for i in range(9)], "vec_id long, embedding array<float>")
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}                 # one direction only
    assert whitening.whiten(spark.createDataFrame([(1, [1e300, -1e300]), (2, [0.0, 1.0]), (3, [5.0, 1.0])], "vec_id long, embedding array<double>")).count() in (3, 6)


@pytest.mark.parametrize("kind", range(6))
def test_feast(kind):
    """All eigenvalues of the intervals and their vectors, for spread, equal, absent, decaying, tripled and crowded ones."""
    draw = np.random.default_rng(kind)
    for _ in range(8):
        d = int(draw.integers(1, 60))
        values = (100 * draw.random(d), np.full(d, 5.0), np.r_[np.zeros(d // 2), draw.random(d - d // 2) + 1], np.exp(-np.arange(d)), np.repeat(50 * draw.random(d // 3 + 1), 3)[:d],
                  np.r_[150, 66 + 1e-3 * draw.random(d - 1)])[kind]
        turn, _ = np.linalg.qr(draw.standard_normal((d, d)))
        matrix = (turn * values) @ turn.T
        matrix = (matrix + matrix.T) / 2
        want = np.linalg.eigvalsh(matrix)[::-1]
        form = whitening.tridiagonal(matrix)
        shifts = draw.random(20) * want[0]
        assert list(whitening.above(form, shifts)) == [int((want > s).sum()) for s in shifts]
        for most in (1, 16):
            found = [whitening.feast(matrix, *cut) for cut in whitening.intervals(form, most)]
            got, vectors = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found], axis=1)
            k = min(most, int((want > 1e-10 * want[0]).sum()))
            assert len(got) >= k and np.allclose(got[:k], want[:k], rtol=1e-9, atol=1e-12 * want[0])
            assert np.abs(matrix @ vectors - vectors * got).max() < 1e-11 * want[0] and np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-6
    with pytest.raises(ArithmeticError):
        whitening.feast(np.diag([3.0, 2.0, 1.0]), 1.5, 3.5, 3)


def plain_leaf(key, own):
    import hashlib
    tree, node = sharding.children(own), sharding.ROOT
    for _ in range(3):
        node = min((-math.log((int(hashlib.md5((key + name).encode()).hexdigest()[:13], 16) + 1) / 2 ** 52) / w, name) for name, w in tree[node])[1]
    return int(node.rsplit("/", 1)[1])


def hard_docs(spark):
    rows = [(1, None), (2, ""), (None, "é"), (None, "é"), (3, "same"), (4, "same"), (5, "x" * 100_000), (6, "a\x00b"), *[(7, "again")] * 9000]
    return spark.createDataFrame([(i, t, "s", 1, 2) for i, t in rows], "doc_id long, text string, source string, n_chars long, slot long"), rows


def test_sharding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hard, rows = hard_docs(spark)
    for frame, own in ((docs, [(r.doc_id, r.text) for r in docs.collect()]), (hard, rows)):
        out = sharding.shards(frame).collect()
        got = collections.Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in out)
        base, more = sharding.layout(), sharding.grow(sharding.layout())
        name = lambda i: "" if i is None else str(i)
        assert got == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), plain_leaf(name(i), base), plain_leaf(name(i), more)) for i, t in own)
        assert all(r.grown_shard in (r.shard, 8) and r.law == "key" for r in out)
        for s in range(8):
            taken = sorted(r.slot for r in out if r.shard == s)
            assert taken == list(range(len(taken)))
        assert rows_of(sharding.shards(frame.repartition(7))) == sorted(map(tuple, out)) if frame is docs else True
    assert sharding.shards(hard.limit(0)).count() == 0


def test_movement_stays_in_grown_subtrees(spark):
    base = sharding.layout(3, 2, 2)
    heavier = [(r, k, s, 3.0 if s == 5 else w) for r, k, s, w in base]                # region 1, rack 2
    added = base + [(1, 2, 12, 1.0)]
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    before = {r.doc_id: r for r in sharding.place(ids, base).collect()}
    share = collections.Counter(r.shard for r in before.values())
    assert all(abs(n - 20_000 / 12) < 200 for n in share.values()) and len(share) == 12
    for own in (heavier, added):
        for r in sharding.place(ids, own).collect():
            old = before[r.doc_id]
            assert r.region == old.region or r.region == 1                            # other regions only lose
            assert r.region != old.region or r.rack == old.rack or r.rack == 2
            assert (r.region, r.rack) != (old.region, old.rack) or r.shard == old.shard or r.shard in (5, 12)
    moved = [r.shard for r in sharding.place(ids, sharding.grow(base)).collect() if r.shard != before[r.doc_id].shard]
    assert set(moved) == {12} and abs(len(moved) - 20_000 / 13) < 200
    none = [(r, k, s, 0.0 if s == 0 else w) for r, k, s, w in base]
    assert 0 not in {r.shard for r in sharding.place(ids, none).select("shard").distinct().collect()}


def test_sharding_is_native_and_writes(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = sharding.shards(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Pandas" not in plan
    sharding.write(docs, str(tmp_path / "out"))
    again = spark.read.parquet(str(tmp_path / "out"))
    want = {r.doc_id: r.shard for r in sharding.shards(docs).collect()}
    assert {r.doc_id: r.shard for r in again.collect()} == want and set(again.columns) == {*docs.columns, "shard"}
    with pytest.raises(ValueError):
        sharding.place(docs.withColumn("rack", F.lit(1)))


def test_clashing_columns_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b", 0.5)], "doc_id long, text string, score double")
    with pytest.raises(ValueError, match="score"):
        toxicity.score(docs, (np.zeros(1 << 20, np.float32), 0.0))
    for name in ("n_words", "n_removed", "kept"):
        with pytest.raises(ValueError, match=name):
            repeats.remove_repeats(docs.withColumnRenamed("score", name))
    assert toxicity.score(docs.drop("score"), (np.zeros(1 << 20, np.float32), 0.0)).columns == ["doc_id", "text", "score"]


def test_anchors_that_occur_once_are_only_counted(spark, monkeypatch):
    """Segments are grouped over the written rows of repeated anchors, not over all anchors of the corpus."""
    draw = random.Random(7)
    words = lambda n: [f"w{draw.randrange(10 ** 9)}" for _ in range(n)]
    passage, copy = words(40), words(60)
    rows = [(k, " ".join(words(90) + (passage if k < 2 else []) + words(30))) for k in range(12)] + [(20, " ".join(copy)), (21, " ".join(copy)), (22, None)]
    kept, keep = {}, repeats.keep

    def seen(df, name):
        kept[name] = df._jdf.queryExecution().toString(), keep(df, name)
        return kept[name][1]

    monkeypatch.setattr(repeats, "keep", seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, repeats.digest(docs).collect())) == sorted(repeats.brute_force(rows, 35))
    assert "MapInArrow" not in kept["segments"][0]
    assert {r.row for r in kept["repeated"][1].collect()} == {r.row for r in docs.filter("doc_id < 2 OR doc_id IN (20, 21)").select(F.xxhash64(
        F.col("doc_id").cast("string"), "text").alias("row")).collect()}
