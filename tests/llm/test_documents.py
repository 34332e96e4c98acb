"""Operators on documents against brute force, with nulls, empty, long, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import decontaminate, idfile, idtable, langmodel, neardup, packing, quality, tokens

SCHEMA = "doc_id long, text string, lang string, node string, score double, block string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 1.0, "y") for i, t in rows], SCHEMA)


def invented(n, seed, words=60, vocabulary=400):
    r = random.Random(seed)
    return [" ".join(f"{'abcdefgh'[k % 8]}w{k}" for k in (int(r.random() ** 2 * vocabulary) for _ in range(r.randint(1, words)))) for _ in range(n)]


def rows_with_edges(seed=0, n=60):
    texts = invented(n, seed)
    return [*enumerate(texts), (1000, None), (1001, ""), (1002, "  \n\t"), (1003, "One, word."), (1004, " ".join(invented(1, 9, 4000))), (1005, texts[3]), (1005, texts[3]), (None, texts[4]), (1006, "É é naïve — “x” 日本語 12.5 don't"), (1007, "a  b\n\nc <|endoftext|> d e")]


def brute_windows(docs, items, width=13):
    ws = lambda t: decontaminate.words(t.encode() if t is not None else None)
    out = []
    for d, t in docs:
        w, hit, found = ws(t), set(), set()
        for i, x in items:
            v = ws(x)
            if i is None or not v:
                continue
            n = min(width, len(v))
            for a in range(len(v) - n + 1):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit.update(range(b, b + n))
                        found.add(str(i))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block_bytes", [8_000_000, 200])
def test_decontaminate(spark, block_bytes):
    docs = rows_with_edges()
    w = docs[5][1].split() + docs[6][1].split() + docs[7][1].split()
    items = [(1, " ".join(w[:20]).upper()), (2, " ".join(w[3:9])), (3, "one word"), (3, "one word"), (10, "Nothing of this kind"), (4, None), (5, ""), (None, "one word"), (6, " ".join(w[10:40]))]
    docs += [(2000, "x " * 30 + " ".join(w[:14]) + ". y"), (2001, " ".join(w[:12])), (2002, "ONE-WORD one word")]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    got = [tuple(r) for r in decontaminate.judge(table(spark, docs), bench, block_bytes=block_bytes).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(brute_windows(docs, items), key=key)


@pytest.mark.parametrize("block_bytes", [8_000_000, 200])
def test_decontaminate_repeated_and_very_long(spark, block_bytes):
    words = [f"w{k}" for k in range(30_000)]
    planted = " ".join(f"p{k}" for k in range(2000))
    docs = [(1, " ".join(words) + " " + planted), (2, " ".join(words)), (2, " ".join(words)), (3, planted), (3, planted), (None, planted), (4, None), (4, None)]
    items = [(1, " ".join(planted.split()[:60])), (2, " ".join(planted.split()[50:200])), (3, " ".join(words[100:113])), (4, "nowhere " * 40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.judge(table(spark, docs), bench, block_bytes=block_bytes).collect()]
    want = [(1, 32_000, 213, 3, False), (2, 30_000, 13, 1, False), (2, 30_000, 13, 1, False), (3, 2000, 200, 2, True), (3, 2000, 200, 2, True), (None, 2000, 200, 2, True), (4, 0, 0, 0, False), (4, 0, 0, 0, False)]
    assert Counter(got) == Counter(want)


def test_decontaminate_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.judge(table(spark, []), none).count() == 0
    assert not decontaminate.judge(table(spark, [(1, "a b")]), none).first().contaminated


def shingle_set(text):
    w = text.encode().lower().split() if text else []
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute_components(rows, percent=85):
    sets = [shingle_set(t) for _, t in rows]
    lab = list(range(len(rows)))
    find = lambda x: x if lab[x] == x else find(lab[x])
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and sets[j]:
            lab[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(low.get(find(i), d))) for i, (d, _) in enumerate(rows))


def near_copies(n, seed, words=80, edits=3):
    r = random.Random(seed)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        c = list(base)
        for _ in range(r.randint(0, edits)):
            c[r.randrange(len(c))] = f"e{r.randint(0, 10**6)}"
        out.append(" ".join(c))
    return out


@pytest.mark.parametrize("chunk", [1000, 7])
def test_minhash(spark, monkeypatch, chunk):
    rows = rows_with_edges(1, 20) + [(3000 + i, t) for i, t in enumerate(near_copies(60, 5) + near_copies(12, 6, 30, 1))] + [(4000, near_copies(1, 5)[0].upper())]
    monkeypatch.setattr(neardup._settled, "__defaults__", (chunk,))
    got = [(str(r.doc_id), r.n_shingles, str(r.component_id), r.kept, r.doc_id) for r in neardup.label(table(spark, rows)).collect()]
    assert sorted(g[:3] for g in got) == brute_components(rows)
    assert all(g[3] == (g[0] == g[2]) for g in got)


def test_minhash_null_ids(spark):
    """A null id is linked like any other: as a near copy, as a bridge, and among null ids only."""
    words = lambda a, z: [f"w{i}" for i in range(a, z)]
    near, bridge, alone = words(0, 100), words(200, 300), words(400, 500)
    rows = [(5, near), (None, [*near, "more"]), (6, bridge), (None, bridge[8:] + words(300, 308)), (7, bridge[16:] + words(300, 316)), (None, alone), (None, [*alone, "more"]), (None, [*alone, "more"]), (8, words(600, 700))]
    rows = [(i, " ".join(w)) for i, w in rows]
    percent = 80
    assert 100 * len(shingle_set(rows[2][1]) & shingle_set(rows[4][1])) < percent * len(shingle_set(rows[2][1]) | shingle_set(rows[4][1]))
    got = [(str(r.doc_id), r.n_shingles, str(r.component_id)) for r in neardup.label(table(spark, rows), percent=percent).collect()]
    assert sorted(got) == brute_components(rows, percent)
    assert [g[2] for g in sorted(got) if g[0] == "7"] == ["6"] and sum(g[0] == "None" and g[2] == "5" for g in got) == 1


def test_minhash_parts(spark):
    assert neardup.label(table(spark, [])).count() == 0
    x, y = (s for s in neardup.shingle_sets([b" ".join(str(i).encode() for i in range(a, a + 400)) for a in (0, 40)]))
    j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((neardup.signature(x, 2000) == neardup.signature(y, 2000)).mean() - j) < 0.05
    kept = neardup.deduplicated(table(spark, [(2, "a b c d e f"), (1, "A b c d e f"), (3, "z")]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and kept.columns == SCHEMA.replace(",", "").split()[::2]


def test_components(spark):
    from ledgerlark.llm.components import components

    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (200, 200), (7, 3), (7, 3)] + [(500, x) for x in range(501, 540)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[101] == got[102] == 100 and all(got[x] == 500 for x in range(500, 540)) and 200 not in got


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_word_memory(name, spaced, monkeypatch):
    m = tokens.WordMemory(tokens.vocabulary(name), spaced)
    texts = [t or "" for _, t in rows_with_edges(2, 30)] + ["A'S it's x_y --- (z) é́ ﬁ İ ß Σας ​ ½ ², end.", "\x00 a\x00b", "a\r\nb\tc", " lead", "trail ", "ǅ. Ω! ʰa", "İ! Word, É!? ab\u0307! J\u030c."]
    want = [np.frombuffer(m.whole(t), "<u4").tolist() + [1] for t in texts]
    for _ in range(2):
        for part in (slice(0, None), slice(3, 9), slice(0, 0)):
            ids, counts = m.encode(pa.array([*texts, None])[:-1][part], 1)
            assert ids.tolist() == sum(want[part], []) and counts.tolist() == list(map(len, want[part]))
        monkeypatch.setattr(tokens, "MOST", 5)
    assert m.encode(pa.array([None, ""], pa.string()), 1)[0].tolist() == [1, 1]


@pytest.mark.parametrize("n", [0, 1, 5, 255, 256, 4097, 20000])
def test_idfile(n):
    r = np.random.default_rng(n)
    ids = (r.zipf(1.3, n) % 49408).astype(np.int32)
    ids[: n // 3] = 7
    blocks = idfile.encode_blocks(ids, 11, 49408, block=6000, lanes=9)
    back = idfile.decode_blocks(blocks)
    assert len(blocks) == -(-n // 6000) and (np.concatenate(back) if back else ids[:0]).tolist() == ids.tolist()
    for b, part in zip(blocks[:2], back[:2], strict=True):  # each block alone
        assert idfile.decode_blocks([b])[0].tolist() == part.tolist()


def test_idfile_damage_and_gain():
    ids = np.tile(np.arange(50, dtype=np.int32), 200)
    block = idfile.encode_blocks(ids, 0, 49408)[0]
    assert len(block) * 8 < len(ids) * 4
    for at in (idfile.HEAD.size + 4, idfile.HEAD.size - 6):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="block"):
            idfile.decode_blocks([bytes(bad)])


def direct(rows, name):
    m = tokens.WordMemory(tokens.vocabulary(name), True)
    return [np.frombuffer(m.whole(t or "") + np.array([1], "<u4").tobytes(), "<u4") for _, t in rows]


def test_id_table(spark, tmp_path):
    rows = sorted((r for r in rows_with_edges(3) if r[0] is not None and r[0] != 1005))
    random.Random(1).shuffle(shuffled := list(rows))
    files = idtable.write(table(spark, shuffled), tokens.vocabulary("word_bpe_49k.json"))
    got = [tuple(r) for r in idtable.read(files).orderBy("doc_id").collect()]
    want, start = [], 0
    for (d, _), ids in zip(rows, direct(rows, "word_bpe_49k.json"), strict=True):
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    names = idtable.export(files, str(tmp_path))
    assert sum(open(n, "rb").read()[:4] == b"LLID" for n in names) == len(names) > 0
    assert idtable.read(idtable.write(table(spark, []), tokens.vocabulary("word_bpe_49k.json"))).count() == 0
    again = idtable.read(idtable.write(table(spark, [(1, "a"), (1, "a"), (None, None)]), tokens.vocabulary("word_bpe_49k.json"))).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in again) == [("1", 2), ("1", 2), ("None", 1)]


@pytest.mark.parametrize("group_pieces", [8192, 16])
def test_packing(spark, group_pieces):
    rows = rows_with_edges(4)
    got = packing.pack(table(spark, rows), sequence=64, group_pieces=group_pieces, keep_ids=True).collect()
    ids = Counter()
    for (d, _), x in zip(rows, direct(rows, "byte_bpe_50k.json"), strict=True):
        ids[(d, x.tobytes())] += 1
    whole = {}
    for (d, b), n in ids.items():
        for s in range(0, len(b) // 4, 64):
            part = b[4 * s : 4 * s + 256]
            whole[(d, s, len(part) // 4, zlib.crc32(part), len(b) // 4)] = n
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == Counter(whole)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)
    for _, seq in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in seq:
            assert r.offset == at
            at += r.length
        assert at <= 64
    used, filled = len({r.sequence_id for r in got}), sum(r.length for r in got)
    groups = len({r.sequence_id >> 32 for r in got})
    assert used <= 11 / 9 * filled / 64 + 2 * groups  # first fit decreasing, in each group
    assert packing.pack(table(spark, [])).count() == 0


def test_first_fit():
    r = np.random.default_rng(0)
    sizes = r.integers(1, 100, 500)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    free = []
    for i in np.argsort(-sizes, kind="stable"):
        b = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
        if b == len(free):
            free.append(100)
        assert (bins[i], offsets[i]) == (b, 100 - free[b])
        free[b] -= sizes[i]


@pytest.mark.parametrize("block_bytes", [8_000_000, 3000])
def test_language_model(spark, block_bytes):
    rows = rows_with_edges(5)
    got = langmodel.score(table(spark, rows), mass=(8.0, 2.0), block_bytes=block_bytes).collect()
    seqs = [((d, t), [*(t or "").encode().lower().split(), "end"]) for d, t in rows]
    out = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    c, b, e = Counter(), Counter(), Counter()
    for (d, _), w in seqs:
        if not out(d):
            c.update(w)
            b.update(zip(["start", *w], w))
            e.update(zip(["start", *w], w, w[1:]))
    n, v = sum(c.values()), len(c)
    p = lambda w: (c[w] + 1) / (n + v + 1)
    p2 = lambda h, x: (b[h, x] + 8 * p(x)) / ((c["end"] if h == "start" else c[h]) + 8)
    want = []
    for (d, _), w in seqs:
        s = math.log10(p2("start", w[0])) + sum(math.log10((e[g, h, x] + 2 * p2(h, x)) / (b[g, h] + 2)) for g, h, x in zip(["start", *w], w, w[1:]))
        want.append((str(d), out(d), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(p(x)) for x in w), s))
    got = sorted((str(r[0]), *r[1:]) for r in got)
    for x, y in zip(got, sorted(want), strict=True):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:])
    assert langmodel.score(table(spark, [])).count() == 0


@pytest.mark.parametrize("block_bytes", [8_000_000, 3000])
def test_language_model_with_equal_hashes(spark, block_bytes):
    """Words whose hashes are equal keep their own counts: n_known, train_tokens and base_score don't change."""
    rows = rows_with_edges(5)
    exact, short = (sorted(tuple(map(str, r[:5])) + (round(r[5], 9),) for r in langmodel.score(table(spark, rows), block_bytes=block_bytes, word_bits=bits).collect()) for bits in (64, 3))
    assert exact == short and len(exact) == len(rows)


def test_automaton_sums_to_one():
    """From every state the next token's probabilities sum to one, with one class for all unknown words: texts that go on
    from each state with each word are traversed with the counts of the first three."""
    texts = [b"a b a c", b"b b a", b"c"]
    counted = [(w + " end").split() for w in (t.decode() for t in texts)]
    for state in ("", "a", "a b", "c c", "b a"):
        tries = [f"{state} {w}".strip().encode() for w in "abc"] + [state.encode()]
        grams = langmodel.BlockGrams([*texts, *tries, f"{state} zz".encode()], np.array([True] * 3 + [False] * 5), 3)
        words, longer = np.zeros(grams.width, dtype=np.int64), np.zeros(len(grams.pairs) + len(grams.triples), dtype=np.int64)
        words[grams.words[0]], longer[grams.grams[0]] = grams.words[3], grams.grams[3]
        weights = langmodel.Automaton(grams, words, longer, sum(map(len, counted)), 4, (2.0, 0.5)).traversed()
        at = np.cumsum(grams.sizes) - grams.sizes + len(state.split())
        assert sum(10 ** weights[at[3:]]) == pytest.approx(1)


def noisy(r, good):
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))
    if good:
        return "\n".join(" ".join(word() for _ in range(r.randint(6, 14))).capitalize() + "." for _ in range(r.randint(1, 6)))
    return "\n".join(" ".join(word() + r.choice(["###", "&&&", " |", "%%"]) for _ in range(r.randint(3, 9))) for _ in range(r.randint(1, 6)))


def test_quality(spark):
    r = random.Random(3)
    labels, rows = [], []
    for i in range(400):
        good = r.random() < 0.7
        rows.append((i, noisy(r, good)))
        labels.append((i, int(good), 0, "t"))
    rows += [(1000, None), (1001, ""), (1002, " \n "), (0, rows[0][1]), (None, rows[1][1])]
    lab = spark.createDataFrame(labels + [(5, None, 0, "t"), (None, 1, 0, "t")], "doc_id long, quality int, toxic int, text string")
    got = quality.judge(table(spark, rows), lab).collect()
    assert len(got) == len(rows)
    truth = {i: g for i, g, *_ in labels}
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert len(held) > 50 and np.mean([x.predicted == truth[x.doc_id] for x in held]) > 0.95
    assert all(x.held_out == (zlib.crc32(b"" if x.doc_id is None else str(x.doc_id).encode()) % 3 == 1) and x.predicted == (x.score >= 0.5) and 0 <= x.score <= 1 for x in got)
    assert {x.doc_id: x.score for x in got}[1000] == 0.5
    assert {x.score for x in quality.judge(table(spark, rows[:3]), lab.limit(0)).collect()} == {0.5}
    assert quality.judge(table(spark, []), lab).count() == 0
    kept = quality.accepted(table(spark, rows), lab)
    assert kept.columns == table(spark, []).columns and kept.count() == sum(x.predicted for x in got)


def test_marginals():
    """Forward-backward against the sum over all labelings."""
    r = np.random.default_rng(1)
    emit, trans, owner = r.normal(size=7), r.normal(size=(2, 2)), np.array([0, 0, 0, 0, 2, 2, 5])
    p, expected, log_z = quality.marginals(emit, trans, owner)
    want, pairs, z_all = np.zeros(7), np.zeros((2, 2)), 0.0
    for d in (0, 2, 5):
        at = np.flatnonzero(owner == d)
        z, on, tr = 0.0, np.zeros(len(at)), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=len(at)):
            w = math.exp(sum(emit[i] for i, k in zip(at, y, strict=True) if k) + sum(trans[a, b] for a, b in itertools.pairwise(y)))
            z += w
            on += w * np.array(y)
            for a, b in itertools.pairwise(y):
                tr[a, b] += w
        want[at], pairs, z_all = on / z, pairs + tr / z, z_all + math.log(z)
    assert np.allclose(p, want) and np.allclose(expected, pairs) and abs(log_z - z_all) < 1e-9


def test_held_out_rules(spark):
    ids = spark.range(50).withColumnRenamed("id", "doc_id")
    row = ids.select("doc_id", quality.held_out(F.col("doc_id")).alias("q"), langmodel.held_out(F.col("doc_id")).alias("l")).collect()
    assert all(r.q == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.l == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in row)
