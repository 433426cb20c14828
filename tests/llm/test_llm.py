"""The training-text operators against brute force, round trips, held-out accuracy and hard cases."""
import collections
import hashlib
import inspect
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from compare import compare, duck
from wayspark.llm import chat, decontaminate, jaccard, language, licences, mixing, quality, repeats, tokens, toxicity
from wayspark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, score double, _mark long, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty texts, one long text, ties, repeated rows, repeated and null ids, clashing extra columns."""
    near = prose(1, 120)
    texts = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, near, "en", "a"), (5, near, "en", None), (6, near.replace(" ", "  ", 3), "de", "b"),
             (7, near + " and one more", "de", "b"), (8, prose(2, 40_000), "en", "a"), (9, prose(3, 4), "en", "c"), (10, prose(3, 4), "en", "c"), (11, prose(4, 60) + " " + near[:400], "fr", "c"),
             (11, prose(4, 60), "fr", "c"), (12, prose(5, 50), "fr", "c"), (12, prose(5, 50), "fr", "c"), (None, prose(6, 50), "fr", "é"), (13, "a " * 100, "xx", "c"), (14, "123 456 !!", "xx", "c")]
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), 7, 0.5, 3, "x") for i, t, lang, src in texts], SCHEMA).coalesce(2).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert compare(spark, duck(SF), name, QUERIES[name], ORACLES[name], SF)[0] is None


def test_registered():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)} and "pipeline" in entry.queries()


def test_repeats(spark, docs, hard, empty):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, repeats.digest(docs).collect())) == sorted(repeats.brute_force(rows, 35))
    for length in (3, 8, 35):
        rows = [(r.doc_id, r.text) for r in hard.collect()]
        got = collections.Counter(map(tuple, repeats.digest(hard, length=length).collect()))
        assert got == collections.Counter(repeats.brute_force(rows, length))
    assert repeats.digest(empty).count() == 0
    out = repeats.remove_repeats(hard.drop("kept"))
    assert out.count() == 17 and out.columns[:8] == hard.columns[:8]


def test_jaccard(spark, docs, hard, empty, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = jaccard.brute_force(rows)
    assert {r[0]: (r[1], r[2]) for r in jaccard.document_classes(docs).collect()} == want
    unique = hard.filter("doc_id < 11")
    want = jaccard.brute_force([(r.doc_id, r.text) for r in unique.collect()])
    assert {r[0]: (r[1], r[2]) for r in jaccard.document_classes(unique).collect()} == want
    assert jaccard.document_classes(hard).count() == hard.count()
    kept = jaccard.first_of_class(hard)
    assert kept.columns == hard.columns and {r.row for r in kept.collect()} == {7}
    assert sorted(r.doc_id for r in kept.filter("doc_id < 11").collect()) == [1, 2, 3, 4, 8, 9]
    assert jaccard.document_classes(empty).count() == 0
    bands, rows_ = jaccard.banding(0.8, 0.999)
    assert 1 - (1 - 0.8 ** rows_) ** bands >= 0.999


def test_large_family_in_blocks(spark, monkeypatch):
    """Near copies that fill several blocks lose no link."""
    draw, base = random.Random(3), prose(9, 60).split()
    rows = []
    for i in range(90):
        w = list(base)
        w[draw.randrange(60)] = f"w{i % 40}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    got = {r[0]: (r[1], r[2]) for r in jaccard.document_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard.brute_force(rows)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102)]
    got = dict(map(tuple, jaccard.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100)}


def test_leaks(spark, hard, empty):
    item = prose(20, 40)
    edited = item[:60] + "x" + item[62:150] + "zz" + item[150:]
    rows = [(1, f"before {item} after"), (2, prose(21, 30) + edited + prose(22, 10)), (3, prose(23, 200)), (4, None), (5, item[:len(item) // 2]), (6, item.upper().replace(" ", "\n"))]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short"), (10, item)], "item_id long, text string")
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(d, i) for d in (1, 2, 6) for i in (7, 10)}
    by = {(r.doc_id, r.item_id): r for r in found}
    assert by[1, 7].edits == 0 and by[1, 7].start == 7 and by[1, 7].end == 7 + len(item) and 0 < by[2, 7].edits <= 4
    small = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench, block_chars=50)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, found))
    clean = decontaminate.drop_leaks(hard, bench)
    assert clean.columns == hard.columns and clean.count() == hard.count()
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(hard, bench.limit(0)).count() == 0


def _least_edits(passage, text):
    """Edits of the closest place of a passage in a text, over whole rows."""
    import numpy as np
    p, t = (decontaminate.plain(np.frombuffer(x.encode("utf-32-le"), np.uint32)) for x in (passage, text))
    row, at = np.zeros(len(t) + 1, np.int64), np.arange(len(t) + 1)
    for i, c in enumerate(p, 1):
        new = np.append(i, np.minimum(row[1:] + 1, row[:-1] + (t != c)))
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def test_leaks_of_any_length():
    """Passages of 1 to 2,000 characters with up to two edits more than their budget: found exactly where the least edits say so."""
    draw, found = random.Random(1), 0
    for n in range(260):
        size = draw.choice([1, 2, 3, 5, 9, 10, 12, 13, 15, 19, 20, 25, 29, 38, 39, 50, 81, 150, 400, 401, 410, 900, 2000])
        letters = "abcdefgh ij" if n % 5 else "ab"
        passage = "".join(draw.choice(letters) for _ in range(size))
        limit, x = decontaminate.budget(size, 0.08), list(passage)
        for _ in range(draw.randint(0, limit + 2)):
            k = draw.randrange(len(x) + 1)
            x[k:k + draw.randint(0, 1)] = draw.choice(["", "x", "y", "a"])
        noise = lambda: "".join(draw.choice(letters) for _ in range(draw.randint(0, 120)))
        text = noise() + "".join(x[:int(len(x) * draw.choice([1, 1, 1, 0.95, 0.5]))]) + noise()
        got, want = list(decontaminate.closest(decontaminate.indexes([(7, passage)], 10, 0.08), text)), _least_edits(passage, text)
        assert [r[3] for r in got] == ([want] if want <= limit else [])
        assert all(_least_edits(passage, text[start:end]) == want for _, start, end, _ in got)
        found += len(got)
    assert found > 100


def test_leaks_need_the_whole_passage(spark):
    long, short = prose(30, 260)[:1000], prose(31, 20)[:39]
    spoilt = "".join("x" if k in (9, 19, 29) else c for k, c in enumerate(short))           # no gram of ten is left
    rows = [(1, "q " + long[300:710] + " q"), (2, "q " + long + " q"), (3, "q " + spoilt + " q"), (4, "see ok here"), (5, long[:900])]
    bench = spark.createDataFrame([(1, long), (2, short), (3, "ok"), (3, "see ok"), (3, "ok")], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (8_000_000, 300, 10):
        got = sorted((r.doc_id, r.item_id, r.edits) for r in decontaminate.leaks(docs, bench, block_chars=size).collect())
        assert got == [(2, 1, 0), (3, 2, 3), (4, 3, 0), (4, 3, 0)]
        assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, bench, block_chars=size).collect()) == [1, 5]
    assert "Exchange" not in decontaminate.drop_leaks(docs, bench)._jdf.queryExecution().executedPlan().toString()


def test_align_is_edit_distance():
    import numpy as np
    draw = random.Random(5)
    for _ in range(60):
        a, b = ("".join(draw.choice("ab") for _ in range(draw.randint(*n))) for n in ((6, 12), (10, 22)))
        best = min(_edits(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        cost, start, end = decontaminate.align(*(np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (a, b)), 4)
        assert (cost == best) if best <= 4 else cost > 4
        if best <= 4:
            assert _edits(a, b[start:end]) == best


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string"
    said = ["<|im_end|>", "a\\<|b", None, "", "\\", "<<||>>\n<|im_start|>x"]
    rows = [(1, n, "assistant" if n % 2 else "user", t) for n, t in enumerate(said)] + [(None, 0, None, "x"), (2, 0, "assistant", "y"), (2, 0, "assistant", "y"), (3, None, "user", "z")]
    rows += [(4, n, "assistant", f"t{n}") for n in range(200)]
    formatted = chat.format_chats(spark.createDataFrame(rows, schema))
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    turns = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows[:6])
    loss = "".join(t or "" for _, _, r, t in rows[:6] if r == "assistant")
    assert got[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest() and got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[2].n_turns == 2 and got[2].loss_chars == 2 and got[4].n_turns == 200 and all(r.rewrites == 0 for r in got.values()) and None in got
    for text in said:
        assert chat.unescape(chat.escape(text or "")) == (text or "")
    assert chat.digests(chat.format_chats(spark.createDataFrame([], schema))).count() == 0

    def trims(turns):                                    # a template that cuts white space of all but the last turn
        return "".join(f"[{t.strip() if n < len(turns) - 1 else t}]" for n, (_, t) in enumerate(turns))
    text, starts, ends, rewrites = chat.spans(iter([("u", "a "), ("u", "b"), ("u", "c ")]), trims)
    assert rewrites == 1 and text == trims([("u", "a "), ("u", "b"), ("u", "c ")])


def test_chat_looks_back():
    """Templates that look back further than any window give the text of the whole conversation, its spans and its rewrites."""
    def numbers(turns):
        return "<s>" + "".join(f"[{n} {r}: {t}]" for n, (r, t) in enumerate(turns))

    def opens(turns):
        if turns and turns[0][0] != "user":
            raise ValueError("the user speaks first")
        return "".join(f"[{r}: {t}]" for r, t in turns)

    def system_last(turns):                              # the first turn is put into the last one
        return "".join(f"[{t}]" for _, t in turns[:-1]) + "".join(f"[{turns[0][1]} {t}]" for _, t in turns[-1:])

    def late(turns):                                     # shows only where a window has slid already
        return "".join(f"[{turns[n - 90][1]} {t}]" if n >= 90 else f"[{t}]" for n, (_, t) in enumerate(turns))

    def early(turns):                                    # turn 0 is rewritten once, at turn 80
        return "".join("[cut]" if n == 0 and len(turns) > 80 else f"[{t}]" for n, (_, t) in enumerate(turns))
    said = [("system" if n % 3 else "user", f"t{n}") for n in range(110)]
    for render, times in ((numbers, 0), (opens, 0), (system_last, 109), (late, 0), (early, 1)):
        text, starts, ends, rewrites = chat.spans(iter(said), render)
        assert text == render(said) and rewrites == times and len(starts) == len(ends) == 110
    for render in (numbers, opens, system_last):
        assert chat.spans(iter(said), render, 16) == chat.spans(iter(said), render)
        text, starts, ends, _ = chat.spans(iter(said), render)
        assert render is system_last or all(text[a:b].endswith(f" t{n}]") for n, (a, b) in enumerate(zip(starts, ends)))
    calls = []
    assert chat.spans(iter(said), lambda turns: calls.append(len(turns)) or chat.chatml(turns), 16) == chat.spans(iter(said), chat.chatml) and max(calls) == 16


def test_tokens(spark, docs, hard, empty):
    model = tokens.load("piece_bpe_32k.model")
    for df in (docs, hard, spark.createDataFrame([(1, "  a  b ▁c▁ "), (2, "<s> </s> <unk>"), (3, "日本語 　 \x00 é\t\n x" + "z" * 500), (4, " "), (5, "\n")], "doc_id long, text string")):
        want = collections.Counter((r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in df.select("doc_id", "text").collect())
        assert collections.Counter(map(tuple, tokens.count_tokens(df, frequent=64, cache=500).collect())) == want
    assert tokens.count_tokens(empty).count() == 0


def test_licences(spark, docs, hard, empty):
    rows = [(1, "MIT License mit license"), (2, "x Apache--LICENSE, Version 2.0"), (3, "é General\nPublic\tLicense"), (4, None), (5, ""), (6, "All rights reserved. mit licenses"), (7, "Licensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for frame in (df, docs, hard):
        got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licences.scan(frame).collect()]
        want = []
        for r in frame.select("doc_id", "text").collect():
            n, at, names = licences.brute_force(r.text)
            want.append((r.doc_id, n, len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(names))))
        assert collections.Counter(got) == collections.Counter(want)
    labels = {r.doc_id: r.labels for r in licences.scan(df).collect()}
    assert labels[6] == "reserved" and labels[7] == "cc-by-nc" and labels[4] == "" and "apache" in labels[2]
    assert licences.scan(empty).count() == 0


def test_licences_many_notices(spark):
    """Every key phrase that stands is found, however many notices a file holds."""
    texts = {label: text for label, text, _ in licences.TEMPLATES}
    sets = [tuple(texts), *([a, b] for a in texts for b in texts if a < b), ("mit", "bsd", "lgpl"), ("isc", "cc-by-nc", "reserved")]
    rows = [(n, ". ".join(texts[x] for x in own)) for n, own in enumerate(sets)] + [(-1, " ".join(licences.vocabulary()))]
    rows += [(1000 + n, k) for n, k in enumerate(k for _, _, keys in licences.TEMPLATES for k in keys)]

    def want(text):
        words = text.replace(".", "").split()
        holds = lambda p: any(words[i:i + len(p)] == p for i in range(len(words)))
        return ",".join(sorted({x for x, _, keys in licences.TEMPLATES if any(holds(k.split()) for k in keys)} | licences.brute_force(text)[2]))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for part in (frame, frame.filter("doc_id = 0")):
        got = {r.doc_id: r.labels for r in licences.scan(part).collect()}
        assert got == {i: want(t) for i, t in rows if i in got} and got[0] == ",".join(sorted(texts))


def test_language(spark, docs, hard, empty):
    out = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out) and all(0 <= r.score <= 1 for r in out)
    got = {r.doc_id: r for r in language.identify(hard.filter("doc_id is not null")).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[14].lang_pred == "und" and language.identify(hard).count() == hard.count()
    assert language.identify(empty).count() == 0
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_toxicity(spark, hard, empty):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").select("toxic", "predicted", "score").collect()
    true = sum(r.toxic and r.predicted for r in rows)
    assert true >= 0.6 * sum(r.toxic for r in rows) and true >= 0.9 * sum(r.predicted for r in rows)
    none = labels.limit(0)
    assert {r.score for r in toxicity.toxicity(hard, none).collect()} == {0.5} and toxicity.toxicity(empty, labels).count() == 0
    kept = toxicity.drop_toxic(hard, none, threshold=0.6)
    assert kept.columns == hard.columns and kept.count() == hard.count()


def test_toxicity_bound():
    """The fit's sample was once lowered for memory; the documented bound holds."""
    assert inspect.signature(toxicity.fit).parameters["max_rows"].default == 24_000


def test_mixing(spark, docs, hard, empty):
    for frame, block in ((docs, 1024), (docs, 64), (hard, 16)):
        out = mixing.mix(frame, block=block).collect()
        sizes = [len(WORD.findall(r.text or "")) for r in frame.select("text").collect()]
        assert sorted(r.size for r in out) == sorted(sizes) and all(r.taken <= 2 * r.size for r in out)
        assert abs(sum(r.taken for r in out) - 1.5 * sum(sizes)) <= frame.select("source").distinct().count()
        assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(frame, block=block).collect()), key=str)
    assert mixing.mix(empty).count() == 0


def test_schedule_is_even(spark):
    plan = spark.createDataFrame([(1, 500), (2, 300), (3, 200)], "number int, slots long")
    rows = mixing.schedule(plan, 3).collect()
    assert collections.Counter(r.number for r in rows) == {1: 500, 2: 300, 3: 200}
    early = collections.Counter(r.number for r in rows if r.t < 100)
    assert all(abs(early[n] - s) <= 3 for n, s in ((1, 50), (2, 30), (3, 20)))


def test_mix_follows_the_schedule(spark):
    """Each document's first place and number of slots, from the sequence built point by point; stretches of the output hold the sources in proportion."""
    draw = random.Random(7)
    rows = [(i, " ".join("w" for _ in range(draw.randint(0, 9))), draw.choice("aaabbc")) for i in range(900)]
    out = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=16).collect()}
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abc"}
    words = {s: int(next(r.target for r in out.values() if r.source_size == sizes[s]) + 0.5) for s in "abc"}
    slots = {s: words[s] // sizes[s] * -(-sizes[s] // 16) + -(-(words[s] % sizes[s]) // 16) for s in "abc"}
    total, upto, ends = sum(slots.values()), 0, {}
    for s in "abc":
        ends[s] = (upto * 2 ** 31 // total, (upto + slots[s]) * 2 ** 31 // total)
        upto += slots[s]
    times = {s: [] for s in "abc"}
    for t in range(total):
        s = next(s for s in "abc" if ends[s][0] <= t * 1327217885 % 2 ** 31 < ends[s][1])
        if len(times[s]) < slots[s]:
            times[s].append(t)
    for s in "abc":
        times[s] += [total + k for k in range(len(times[s]), slots[s])]
        line = sorted((i for i, t, x in rows if x == s and t), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
        start = 0
        for i in line:
            size, at = out[i].size, []
            for k, t in enumerate(times[s]):
                lo = k % -(-sizes[s] // 16) * 16
                hi = min(lo + 16, sizes[s], words[s] - k // -(-sizes[s] // 16) * sizes[s])
                at += [(t, min(hi, start + size) - max(lo, start))] if lo < start + size and hi > start else []
            assert (out[i].first_slot, out[i].n_slots, out[i].taken) == (min(at)[0] if at else None, len(at), sum(n for _, n in at))
            start += size
    source = {i: x for i, _, x in rows}
    for t in range(0, total - 60, 7):
        seen = {s: len({r.first_slot for r in out.values() if source[r.doc_id] == s and r.first_slot is not None and t <= r.first_slot < t + 60}) for s in "abc"}
        for s in "abc":
            if words[s] <= sizes[s]:                                    # every slot is some document's first
                assert abs(seen[s] - 60 * slots[s] / total) <= 5
    assert any(words[s] <= sizes[s] for s in "abc")


def test_quality(spark, docs, hard, empty):
    for frame in (docs, hard):
        want = collections.Counter()
        for r in frame.select("doc_id", "text").collect():
            w = WORD.findall(r.text or "")
            times = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
            again = len({j for i in range(len(w) - 7) if times[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)})
            lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
            want[(r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), again, len(w) < 20 or 100 * again > 30 * len(w))] += 1
        out = quality.judged(frame).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want
        assert not any(r.kept and r.base_failed for r in out)
    assert quality.judged(empty).count() == 0


def test_divergence(spark):
    row = spark.range(1).select(*(quality.divergence(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias(n) for n, p, q in (
        ("same", (0.5, 0.5), (0.5, 0.5)), ("apart", (1.0, 0.0), (0.0, 1.0))))).first()
    assert row.same == 0 and row.apart == 1


def test_pipeline(spark):
    """Every stage keeps what a plain version of it keeps."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = stages["toxicity"](spark, docs, SF).cache()
    scores = {r.doc_id for r in toxicity.toxicity(docs, labels).filter("predicted = 0").collect()}
    assert {r.doc_id for r in first.collect()} == scores and first.columns == docs.columns
    second = stages["n-gram Jaccard join"](spark, first, SF).cache()
    classes = jaccard.brute_force([(r.doc_id, r.text) for r in first.collect()])
    assert {r.doc_id for r in second.collect()} == {c for c, _ in classes.values()}
    third = stages["substring dedup"](spark, second, SF).cache()
    want = {k: (n, gone) for k, n, gone, _ in repeats.brute_force([(r.doc_id, r.text) for r in second.collect()], 35)}
    assert {r.doc_id: len(WORD.findall(r.text)) for r in third.collect()} == {k: n - gone for k, (n, gone) in want.items() if not gone or gone < n}
    fourth = stages["benchmark decontamination"](spark, third, SF).cache()
    plain = [re.sub(r"\s", " ", r.text.lower()) for r in bench.collect()]
    held = {r.doc_id for r in third.collect() if any(p in re.sub(r"\s", " ", r.text.lower()) for p in plain)}
    gone = {r.doc_id for r in third.collect()} - {r.doc_id for r in fourth.collect()}
    assert held <= gone and fourth.columns == docs.columns
    last = stages["source mix"](spark, fourth, SF).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in fourth.collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, last))
