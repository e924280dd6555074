import hashlib
import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnfold.llm import bytesnp as B
from turnfold.llm import common as C
from turnfold.llm import line_dedup, near_dedup, queries, sentencepiece_viterbi, token_files
from turnfold.llm import imatch
from turnfold.llm.imatch import below, fingerprints
from turnfold.llm.line_dedup import MIN_CHARS, line_deduplicated
from turnfold.llm.mixing import mixed
from turnfold.llm.near_dedup import near_components, near_deduplicated
from turnfold.llm.pii import personal_data
from turnfold.llm.quality_pu import accepted, estimate_prior, quality_scores
from turnfold.llm.quality_rules import PRIOR, RULES, count_text, quality_rules
from turnfold.llm.substring_dedup import substring_deduplicated

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k long, _maybe string, n_dropped string, _score string"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en" if k % 2 else None, None if k % 3 else "a", None if t is None else len(t), 1, "x", "y", "z") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def documents(spark, sf):
    df = C.table(spark, sf, "documents")
    return df, [tuple(r) for r in df.select("doc_id", "text").collect()]


#: Nulls, empty, white space, one word, ties and repeats, letters of several bytes, a very long text.
ODD = [None, "", " \n\t ", "one", "one", "ñandú ÉTÉ straße " * 60, "ñandú ÉTÉ straße " * 60, "a" * 5000, LONG, LONG + " end", "x\n\n" * 300, "日本語 テキスト " * 80]


def by_id(df, *cols):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *cols).collect()}


def check_pii(df, docs):
    got = by_id(personal_data(df), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    for i, t in docs:
        base = brute.pii(t or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i][:4] == tuple(sum(k == x for x, _, _ in base) for k in ("email", "ip", "card", "phone")), i
        assert got[i][4] == hashlib.sha256(text.encode()).hexdigest(), (i, base, got[i])
        assert {x for x in text.split(",") if x} <= set(got[i][5].split(","))


def test_pii(spark, sf):
    check_pii(*documents(spark, sf))
    hard = ["a@b.c_d@e.fg.h", "1.2.3.4.5.6.7.8 999.1.1.1 00255.1.1.1", "4532 0151 1283 0366  4532-0151-1283-0366x4532015112830366", "+1 (988) 555-2485 +12 + 1", "+1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6-7", "é€ a.b@x-y.co.uk, 10.0.0.1", "@@a@b..c@d.e", "12 34- 56 7", "a" * 60_000 + "@b", "1" * 60_000, "1 2-" * 20_000, "a." * 30_000 + "@x.y", "call (212) 555-1234 or mail joe [at] example [dot] com"]
    check_pii(df := frame(spark, [*ODD, *hard]), list(enumerate([*ODD, *hard])))
    assert personal_data(df.limit(0)).count() == 0


def test_substrings(spark, sf):
    df, docs = documents(spark, sf)
    got = by_id(substring_deduplicated(df), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert [got[i] for i, _ in docs] == brute.substrings([t for _, t in docs])
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 9)))
    base = [" ".join(word() for _ in range(r.choice([60, 200, 400]))) for _ in range(25)]
    texts = [*ODD[:8], "ab" * 900, "ab" * 350, *base]
    for n in (398, 399, 400, 401, 402, 527, 655, 900, 1500):  # passages of about the threshold, anywhere
        for _ in range(3):
            a, b = r.choice(base), r.choice(base)
            s = r.randint(0, max(0, len(a) - n))
            texts.append(b[: r.randint(0, 300)] + a[s : s + n] + r.choice(base)[: r.randint(0, 500)])
    got = by_id(substring_deduplicated(frame(spark, texts)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert [got[i] for i in range(len(texts))] == brute.substrings(texts)
    rows = substring_deduplicated(frame(spark, ["q" * 450, "q" * 450, "z"], [3, 3, 3])).collect()
    assert sorted(r.n_removed for r in rows) == [0, 450, 450]
    assert substring_deduplicated(frame(spark, [])).count() == 0


def test_passages(spark, sf):
    df, docs = documents(spark, sf)
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 3))) + str(r.randint(0, 999))
    made = [[word() for _ in range(r.choice([20, 80, 300]))] for _ in range(30)]
    for n in (35, 36, 50, 51, 52, 70, 120):  # passages of about the bounds, anywhere, parted anyhow
        for _ in range(3):
            a, b = r.choice(made[:30]), r.choice(made[:30])
            s = r.randint(0, max(0, len(a) - n))
            made.append([word() for _ in range(5)] + b[: r.randint(0, 20)] + [word()] + a[s : s + n] + [word()])
    texts = [*ODD[:8], *("".join(w + r.choice([" ", "\n", "\t "]) for w in x) for x in made)]
    for table, rows in ((df, [t for _, t in docs]), (frame(spark, texts), texts)):
        got = by_id(substring_deduplicated(table), "n_passages")
        ids = [i for i, _ in docs] if table is df else range(len(rows))
        for i, must, may in zip(ids, brute.repeated_strings_of_words(rows, 51), brute.repeated_strings_of_words(rows, 36), strict=True):
            assert must <= (got[i][0] > 0) <= may
    copies = substring_deduplicated(frame(spark, [" ".join(made[1][:51]), " ".join(made[1][:51]), None], [1, 2, 3]))
    assert by_id(copies, "n_passages") == {1: (1,), 2: (1,), 3: (0,)}


def test_quality_rules(spark, sf):
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for df, docs in (documents(spark, sf), (frame(spark, ODD), list(enumerate(ODD)))):
        out = quality_rules(df)
        got = by_id(out, *cols, "base_failed", "kept")
        for i, t in docs:
            want = brute.rules(t or "")
            failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
            assert got[i][:6] == (*want, failed)
            assert not (failed and got[i][6])
    assert quality_rules(frame(spark, [])).count() == 0
    assert count_text("a b c a b c\na b c".encode())[:5] == (9, 9, 0, 0, 9)


def test_quality_rules_verdicts(spark, sf):
    df, docs = documents(spark, sf)
    group = {r.doc_id: (r.lang, r.source) for r in df.collect()}
    rows = {}
    for i, t in docs:
        n, chars, symbols, dup, repeat = brute.rules(t or "")
        lines = sum(bool(x.strip(" \t\n\r\x0b\x0c")) for x in (t or "").split("\n"))
        rows[i] = (n, repeat, {"symbol_ratio": symbols / n, "dup_line_ratio": dup / lines, "repeat_ratio": repeat / n, "mean_word_chars": chars / n} if n else {})
    at = lambda values, p: sorted(values)[max(0, -(-len(values) * p // 100) - 1)]
    got = by_id(quality_rules(df), "kept")
    for i, (n, repeat, m) in rows.items():
        good = n >= 50 and 100 * repeat <= 50 * n
        for c, side, slack in RULES if good else ():
            whole = [x[2][c] for x in rows.values() if x[0]]
            own = [x[2][c] for j, x in rows.items() if x[0] and group[j] == group[i]]
            low, high = ((len(own) * at(own, p) + PRIOR * at(whole, p)) / (len(own) + PRIOR) for p in (25, 75))
            wide = 3 * (high - low) + slack
            good &= m[c] <= high + wide if side == "high" else m[c] >= low - wide
        assert got[i] == (good,), i


def test_quality_rules_adapt(spark):
    r = random.Random(1)
    text = lambda k: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(r.randint(0, 999)) + ("#" if r.random() < k else "") for _ in range(80))
    rows = [(i, text(0.02 if i % 2 else 0.5), "en", f"s{i % 2}") for i in range(200)] + [(200, text(0.5), "en", "s1")]
    got = by_id(quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")), "kept")
    assert not got[200][0] and sum(v[0] for v in got.values()) >= 190


def test_token_files(spark, sf, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = [*ODD, "it's  5,000 <|endoftext|> tabs\t\t x\r\n"]
    for k, (df, docs) in enumerate((documents(spark, sf), (frame(spark, odd), list(enumerate(odd))))):
        got = by_id(token_files.token_files(df, queries.tokenizer_file("byte_bpe_50k.json"), public_tokenizers.PATTERN, f"file://{tmp_path}/{k}"), "start", "n_tokens", "ids_crc32")
        start = 0
        for i, text in sorted(docs):
            ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
            assert got[i] == (start, len(ids), brute.crc(ids))
            start += len(ids)
    assert token_files.token_files(frame(spark, []), queries.tokenizer_file("byte_bpe_50k.json"), public_tokenizers.PATTERN, f"file://{tmp_path}/e").count() == 0
    rows = token_files.token_files(frame(spark, ["b", "a", None], [7, 7, None]), queries.tokenizer_file("byte_bpe_50k.json"), public_tokenizers.PATTERN, f"file://{tmp_path}/n").orderBy("start").collect()
    assert [(r.doc_id, r.start) for r in rows] == [(None, 0), (7, 1), (7, 3)]


def test_shard_is_checked(tmp_path):
    from pyarrow import fs

    path = str(tmp_path / "x.tfs")
    with open(path, "wb") as f:
        token_files.write_shard(f, iter([(1, np.arange(50, dtype=np.uint32)), (2, np.arange(9, dtype=np.uint32))]))
    store = fs.LocalFileSystem()
    with store.open_input_file(path) as f:
        shard = token_files.Shard(f)
        assert shard.ids(1).tolist() == list(range(9)) and shard.entries["doc_id"].tolist() == [1, 2]
    raw = bytearray(open(path, "rb").read())
    raw[int(shard.entries["offset"][1]) + 12] ^= 255
    open(path, "wb").write(raw)
    with store.open_input_file(path) as f:
        broken = token_files.Shard(f)
        assert len(broken.ids(0)) == 50  # other frames stay readable
        with pytest.raises(Exception):  # noqa: B017
            broken.ids(1)


def test_fingerprints(spark, sf):
    for df, docs in (documents(spark, sf), (frame(spark, ODD), list(enumerate(ODD)))):
        got = by_id(fingerprints(df), "n_chars", "edited_sha256", "fingerprint", "near_edited", "near_next")
        edited = brute.fingerprint_text(docs)
        same = {}
        for i, t in docs:
            assert got[i][0] == len(t or "")
            assert got[i][1] == hashlib.sha256(edited[i].encode()).hexdigest()
            assert same.setdefault(t or "", got[i][2]) == got[i][2]
            assert 0 <= got[i][3] <= 1 and 0 <= got[i][4] <= 1
        if len(docs) > 50:
            assert np.mean([x[3] for x in got.values()]) > 0.15 + np.mean([x[4] for x in got.values()])
    assert fingerprints(frame(spark, [])).count() == 0
    assert fingerprints(frame(spark, ["a b", "a b", None], [None, 5, 5])).count() == 3


def plain_hashes(lex, text):
    """The subset hashes of a text, subset by subset and term by term."""
    found = brute.term_ids(text) & set(lex)
    out = []
    for s in range(imatch.SUBSETS):
        seed, rate = int(B.seeded(imatch.SUBSETS, 3)[s]), imatch.RATES[s // imatch.PER_RATE]
        some = [t for t in sorted(found) if int(B.mix(np.array([t + seed & 2**64 - 1], np.uint64))[0]) < int(rate * 2**64)]
        total = sum(int(B.mix(np.array([t * 0x9E3779B97F4A7C15 + 1 & 2**64 - 1], np.uint64))[0]) for t in some) & 2**64 - 1
        out.append(max(1, int(B.mix(np.array([total], np.uint64))[0]) >> 48) if total else 0)
    return out


def plain_likeness(a, b, same):
    per = []
    for r in range(len(imatch.RATES)):
        pairs = [(x, y) for x, y in zip(a[16 * r : 16 * r + 16], b[16 * r : 16 * r + 16], strict=True) if x or y]
        per.append((sum(x == y for x, y in pairs), len(pairs)))
    if not any(n for _, n in per):
        return float(same)
    full = [e / n for e, n in per if n >= 6]
    return max(full) if full else sum(e for e, _ in per) / sum(n for _, n in per)


def test_fingerprints_equal_plain_ones(spark, sf, monkeypatch):
    docs = documents(spark, sf)[1][:70] + [(None, "null id"), (900, None), (901, ""), (902, "a b")]
    monkeypatch.setattr(imatch, "SHARD_BYTES", 9000)
    got = {r[0]: r for r in fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    df, n = {}, len(docs)
    for _, t in docs:
        for x in brute.term_ids((t or "").encode()):
            df[x] = df.get(x, 0) + 1
    lex = [t for t, c in df.items() if max(2, imatch.LEAST * n) <= c <= max(2, imatch.MOST * n)]
    assert len(lex) > 100 and len(got) == n
    order = sorted(((-1 if i is None else i, t or "") for i, t in docs), reverse=True)
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % n][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r, h = got[None if i < 0 else i], [plain_hashes(lex, x.encode()) for x in (t, edited, nxt)]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == tuple("".join(f"{x:04x}" for x in y) if any(y) else "t" + hashlib.sha256(z.encode()).hexdigest()[:32] for y, z in zip(h, (t, edited), strict=False))
        assert (r.near_edited, r.near_next) == (plain_likeness(h[0], h[1], t == edited), plain_likeness(h[0], h[2], t == nxt))


def test_bounds(spark):
    bounds = [-5, 0, 3, 9, 10, 11, 40, 41, 42, 100]
    for b in (bounds, bounds[:1], []):
        assert [r.n for r in spark.createDataFrame([(i,) for i in range(-9, 110)], "doc_id long").select(below(b).alias("n")).collect()] == [sum(x < i for x in b) for i in range(-9, 110)]


def test_near_dedup(spark, sf):
    df, docs = documents(spark, sf)
    got = by_id(near_components(df, 2), "n_shingles", "component_id", "kept")
    assert [(i, *got[i]) for i, _ in docs] == brute.near(docs)
    r = random.Random(3)
    texts = list(ODD)
    for size in (12, 40):  # stars, whose leaves are no links, and chains
        hub = [f"t{r.randint(0, 10**6)}" for _ in range(100)]
        for _ in range(size):
            leaf = list(hub)
            for _ in range(r.randint(1, 8)):
                leaf[r.randrange(100)] = f"n{r.randint(0, 10**6)}"
            texts.append(" ".join(leaf))
        for _ in range(size):
            hub[r.randrange(100)] = f"n{r.randint(0, 10**6)}"
            hub[r.randrange(100)] = f"n{r.randint(0, 10**6)}"
            texts.append(" ".join(hub))
    docs = list(enumerate(texts))
    for width in (2, 5):
        got = by_id(near_components(frame(spark, texts), width), "n_shingles", "component_id", "kept")
        assert [(i, *got[i]) for i, _ in docs] == brute.near(docs, width)
    assert near_components(frame(spark, [])).count() == 0
    kept = near_deduplicated(frame(spark, texts), 2)
    assert kept.columns == frame(spark, []).columns
    assert sorted(x.doc_id for x in kept.collect()) == [i for i, *_, k in brute.near(docs, 2) if k]
    rows = near_components(frame(spark, ["a b c d", "a b c d", "a b c d"], [None, 4, 4])).collect()
    assert [x.component_id for x in rows] == [4, 4, 4]


def test_near_dedup_keeps_one_row_of_each_component(spark):
    a, c = "the one text of a group of copies " * 4, " ".join(f"c{i}" for i in range(90))
    b, near = " ".join(f"b{i}" for i in range(60)), c + " d"
    rows = [(1, a), (5, a), (5, b), (7, c), (None, c), (None, "unlike all " + " ".join(f"x{i}" for i in range(40))), (9, near), (1, a), (None, None), (None, None), (3, "")]
    df = spark.createDataFrame([(i, t, "kept") for i, t in rows], "doc_id long, text string, _row_key string")
    got = near_deduplicated(df, 2)
    assert got.columns == df.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    want = [(1, a), (5, b), (7, c), rows[5], (None, None), (None, None), (3, "")]
    assert sorted(map(tuple, got.select("doc_id", "text").collect()), key=key) == sorted(want, key=key)
    only = spark.createDataFrame([(None, a, "x"), (None, a, "x"), (None, b, "x")], df.schema)
    assert sorted(r.text for r in near_deduplicated(only, 2).collect()) == sorted([a, b])


def test_near_dedup_of_a_large_bucket_has_few_tasks(spark):
    r = random.Random(7)
    base, texts = [f"b{i}" for i in range(120)], []
    for _ in range(300):  # each is unlike the others, but most share bands
        at = set(r.sample(range(120), 9))
        texts.append(" ".join(f"n{r.randint(0, 10**9)}" if i in at else w for i, w in enumerate(base)))
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    sc, status = spark.sparkContext, spark.sparkContext.statusTracker()
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sc.setJobGroup("large bucket", "")
        got = by_id(near_components(frame(spark, texts), 2), "n_shingles", "component_id", "kept")
        stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("large bucket") for s in status.getJobInfo(j).stageIds]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    docs = list(enumerate(texts))
    assert [(i, *got[i]) for i, _ in docs] == brute.near(docs)
    assert max(s.numTasks for s in stages if s) <= 500  # 19,859 where both sides of the join of members and centres are split


def test_near_dedup_compares_each_pair_in_one_cell(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CELL", 7)
    sizes = {1: 40, 2: 6, 3: 15}
    nodes = [(key, 1000 * key + i, n) for key, n in sizes.items() for i in range(n)]
    now = spark.createDataFrame([(*x, x[2] - 1) for x in nodes], "key long, node long, size long, minor long")
    for covered in (1.0, 9.0, 64.0):
        centre = now.filter(F.col("node") % 1000 < F.least(F.lit(covered), "minor")).withColumnRenamed("node", "x")
        got = sorted((r.key, r.node, r.x) for r in near_dedup._compared(now, centre, covered).collect())
        assert got == sorted((k, i, 1000 * k + c) for k, i, n in nodes for c in range(min(int(covered), n - 1)))


def test_set_maps_never_rule_out_a_link(spark):
    r = np.random.default_rng(1)
    rows = []
    for k in range(60):
        n = int(r.integers(1, 3000))
        a = r.integers(0, 2**63, n, dtype=np.uint64)
        b = a.copy()
        some = r.random(n) < r.random() * 0.25
        b[some] = r.integers(0, 2**63, int(some.sum()), dtype=np.uint64)
        x = near_dedup.set_maps(np.concatenate((np.sort(a), np.sort(b))), np.array([n, n]))
        fold = np.bitwise_or.reduce(x.reshape(2, -1, near_dedup.FOLDED), axis=1)
        on, fon = np.bitwise_count(x).sum(axis=1), np.bitwise_count(fold).sum(axis=1)
        c = len(np.intersect1d(a, b))
        rows.append((n, n, x[0].view(np.int64).tolist(), x[1].view(np.int64).tolist(), *map(int, (*on, *fon)), *fold[0].view(np.int64).tolist(), *fold[1].view(np.int64).tolist(), 100 * c >= 80 * (2 * n - c)))
    names = ["n", "xn", "map", "xmap", "on", "xon", "fon", "xfon", *near_dedup.FOLDS, *(f"x{f}" for f in near_dedup.FOLDS), "linked"]
    got = spark.createDataFrame(rows, names).select("n", "linked", near_dedup._reachable(80).alias("may")).collect()
    assert all(x.may for x in got if x.linked) and any(x.linked for x in got)
    assert not all(x.may for x in got if not x.linked and x.n < 1000)


def test_sketches_fill_and_estimate():
    r = np.random.default_rng(0)
    a = r.integers(0, 2**63, 900, dtype=np.uint64)
    b = np.concatenate((a[:800], r.integers(0, 2**63, 100, dtype=np.uint64)))
    s = near_dedup.sketches(np.concatenate((a, b, a[:1], a[:3])), np.array([900, 900, 1, 3]), 240)
    assert (s != np.uint64(2**64 - 1)).all()
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.12


def kept_lines(docs):
    first = {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        for n, line in enumerate((t or "").split("\n")):
            if len(line.strip()) >= MIN_CHARS:
                first.setdefault(line, (i, n))
    near = {x for x in first for y in first if first[y] < first[x] and x != y and brute.distance(x, y) <= 1}
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if len(x.strip()) < MIN_CHARS or (first[x] == (i, n) and x not in near)) for i, t in docs}


def test_line_dedup(spark):
    r = random.Random(9)
    lines = ["".join(r.choice("abé ") for _ in range(r.randint(14, 40))) for _ in range(30)]
    for x in list(lines):
        i = r.randrange(len(x))
        lines += [x[:i] + x[i + 1 :], x[:i] + "z" + x[i:], x[:i] + "y" + x[i + 1 :], x[:i] + "yy" + x[i + 1 :]]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randint(0, 9))) for _ in range(50)] + [None, "", "\n\n", "short\nshort", "a" * 400 + "\n" + "a" * 399 + "\n" + "a" * 402]
    df = frame(spark, texts)
    out = line_deduplicated(df)
    assert out.columns == df.columns
    got = by_id(out, "text", "n_chars")
    want = kept_lines(list(enumerate(texts)))
    assert {i: x[0] for i, x in got.items()} == want
    assert all(x[1] == (None if x[0] is None else len(x[0])) for x in got.values())
    assert line_deduplicated(frame(spark, [])).count() == 0
    assert len(line_deduplicated(frame(spark, ["a line that is long enough"] * 3, [1, 1, 2])).filter("text != ''").collect()) == 2


def kept_of_all_lines(docs):
    """Without any cut by length: every line that is not blank counts."""
    first = {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        for n, line in enumerate((t or "").split("\n")):
            if line.strip():
                first.setdefault(line, (i, n))
    near = {x for x in first for y in first if first[y] < first[x] and x != y and brute.distance(x, y) <= 1}
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if not x.strip() or (first[x] == (i, n) and x not in near)) for i, t in docs}


def test_line_dedup_short(spark):
    r = random.Random(10)
    lines = ["".join(r.choice("abé .") for _ in range(n)) for n in range(18) for _ in range(6)]
    for x in list(lines):
        i = r.randrange(len(x) + 1)
        lines += [x[:i] + x[i + 1 :], x[:i] + "z" + x[i:], x[:i] + "y" + x[i + 1 :]]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randint(0, 9))) for _ in range(60)] + ["Share this\nx\n", "Share this\n\n \ny", "share this\n\u00a0\n\u00a0", "\n", None]
    got = by_id(line_deduplicated(frame(spark, texts)), "text")
    want = kept_of_all_lines(list(enumerate(texts)))
    assert {i: x[0] for i, x in got.items()} == want
    assert want[len(texts) - 4] == "\n " and sum(len(t or "") for t in texts) > sum(len(t or "") for t in want.values())


def test_line_dedup_whole_table(spark, sf):
    docs = [(i, t) for i, t in documents(spark, sf)[1]]
    r = random.Random(3)
    huge = "".join(r.choice("abcdef ") for _ in range(1_000_000))
    docs += [(10_001, huge), (10_002, "x\n" + huge[:500_000] + "z" + huge[500_000:]), (10_003, huge), (None, huge[1:])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = by_id(line_deduplicated(df, ("n_lines", "n_dropped")), "text", "n_lines", "n_dropped")
    first = {}
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        for n, line in enumerate((t or "").split("\n")):
            if line.strip():
                first.setdefault(line, ((i is not None, i or 0), n))
    shapes = {}
    for x in first:  # lines at distance 1 share a half and the lesser length, by either rule of halving
        for m in (len(x), len(x) - 1):
            for side in (x[: m // 2], x[len(x) - m // 2 :]):
                shapes.setdefault((m, side), []).append(x)
    near = {x for xs in shapes.values() for x in xs for y in xs if first[y] < first[x] and x != y and brute.within_one(x, y)}
    assert near >= {huge}  # null ids come first: one letter less
    place = lambda i, n: ((i is not None, i or 0), n)
    for i, t in docs:
        keep = [x for n, x in enumerate((t or "").split("\n")) if not x.strip() or (first[x] == place(i, n) and x not in near)]
        assert got[i][0] == "\n".join(keep), i
        assert got[i][1] - got[i][2] == len(keep)
    assert got[10_002][2] >= 1  # a line two edits from the null row's and one from a line that goes itself


def test_line_dedup_clashing_names(spark):
    df = spark.createDataFrame([(1, "same line\nsame line", 42, "a"), (2, "other", 43, "b")], "doc_id long, text string, _n_dropped int, N_LINES string")
    assert sorted(map(tuple, line_deduplicated(df).collect())) == [(1, "same line", 42, "a"), (2, "other", 43, "b")]
    out = line_deduplicated(df, ("n_lines", "n_dropped"))
    assert out.columns == ["doc_id", "text", "_n_dropped", "n_lines", "n_dropped"]
    assert sorted(map(tuple, out.collect())) == [(1, "same line", 42, 2, 1), (2, "other", 43, 1, 0)]


def test_line_dedup_hot_lines(spark, monkeypatch):
    texts = ["\n".join(["the hot line of all", f"own line number {i * 7919}", "warm" if i % 5 == 0 else f"cold {i * 104729}"]) for i in range(60)]
    want = kept_of_all_lines(list(enumerate(texts)))
    monkeypatch.setattr(line_dedup, "HOT", 30)
    for limit in (50_000, 0):
        monkeypatch.setattr(C, "LIGHT_ROWS", limit)
        assert {i: x[0] for i, x in by_id(line_deduplicated(frame(spark, texts)), "text").items()} == want


def files_of_tables(spark, run):
    """The files of each table that `run` writes, by the table's name, where Spark merges no partitions by itself."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before, first = {k: spark.conf.get(k, None) for k in conf}, len(C._TABLES)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        run()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    files = {}
    for at in C._TABLES[first:]:
        name = os.path.basename(at).rsplit("-", 1)[0]
        files[name] = files.get(name, 0) + sum(x.startswith("part-") for x in os.listdir(at.removeprefix("file://")))
    return files


def test_line_dedup_writes_few_files(spark):
    texts = ["\n".join([f"a line of its own, {i * 7919}", f"a line of two, {i // 2 * 104729}", f"near to others {i:04}"]) for i in range(300)]
    files = files_of_tables(spark, lambda: line_deduplicated(frame(spark, texts)).collect())
    assert files.pop("lines") <= 64 and files.keys() >= {"firsts", "shared", "candidates", "candidate-lines", "near-lines", "marked", "drops"}
    assert max(files.values()) <= 4, files


def test_substrings_write_few_files(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("abcdefg ") for _ in range(600)) for _ in range(200)]
    texts += texts[:100] + [x[:50] + y[:500] for x, y in zip(texts[:100], texts[100:], strict=True)]
    files = files_of_tables(spark, lambda: substring_deduplicated(frame(spark, texts)).collect())
    assert files.keys() >= {"digests", "copies", "ranges", "spans", "passages"}
    assert max(files.values()) <= 4, files


def test_mixing(spark, sf):
    df, docs = documents(spark, sf)
    out = mixed(df, copy_col="copy")
    assert out.columns == [*df.columns, "copy"]
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mixed(df, copy_col="copy").collect()))
    rows = [(i, f"text {i}", f"s{i % 2}", 1) for i in range(4000)]
    big = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r.source: r.n for r in mixed(big, {"s0": 1, "s1": 3}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(got["s0"] - 1000) < 120 and abs(got["s1"] - 3000) < 220
    per = mixed(big.filter("source = 's0'").limit(100), {"s0": 1}).groupBy("doc_id").count().count()
    assert 40 < per < 85
    odd = mixed(frame(spark, ODD), {None: 1.0, "a": 40.0})
    assert odd.columns == frame(spark, []).columns and odd.count() > 0
    assert mixed(frame(spark, [])).count() == 0
    clash = spark.createDataFrame([(i, "t", "s", i, i, i) for i in range(40)], "doc_id long, text string, source string, _mix_source long, _salt_of long, COPY long")
    out = mixed(clash, {"s": 1.0}, copy_col="copy")
    assert out.columns == ["doc_id", "text", "source", "_mix_source", "_salt_of", "copy"]
    assert out.count() > 10 and not out.filter("_mix_source <> doc_id or _salt_of <> doc_id").count()


def test_sentencepiece_is_exact(spark, tmp_path):
    import sentencepiece

    path = queries.tokenizer_file("piece_bpe_32k.model")
    raw = open(path, "rb").read()
    # the same pieces as a unigram model, for which the library itself searches with Viterbi
    i = raw.index(b"\x18\x02", len(raw) - 800)
    unigram = str(tmp_path / "u.model")
    open(unigram, "wb").write(raw[:i] + b"\x18\x01" + raw[i + 2 :])
    lib, own = sentencepiece.SentencePieceProcessor(model_file=unigram), sentencepiece_viterbi.Model(path)
    texts = [x or "" for x in ODD[:8]] + ["Hello  world\tand\nmore…", "a  b   c ", "emoji 😀 zzz", "x" * 300, "▁ literal", "The quick brown fox, 1234567890!"]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == lib.encode(t), t
        assert own.decode(ids) == t.replace("▁", " ")


def test_sentencepiece_query(spark, sf):
    df, docs = documents(spark, sf)
    out = sentencepiece_viterbi.sentencepiece_encode(df, queries.tokenizer_file("piece_bpe_32k.model"))
    assert out.count() == len(docs) and not out.filter("not roundtrip").count()
    odd = sentencepiece_viterbi.sentencepiece_encode(frame(spark, ODD), queries.tokenizer_file("piece_bpe_32k.model"), frame(spark, []).columns)
    assert odd.count() == len(ODD) and not odd.filter("not roundtrip").count()
    assert sentencepiece_viterbi.sentencepiece_encode(frame(spark, []), queries.tokenizer_file("piece_bpe_32k.model")).count() == 0


def test_quality_classifier(spark):
    sf = "/root/testdata/sf0.01"
    df, labels = C.table(spark, sf, "documents"), C.table(spark, sf, "labels")
    out = quality_scores(df, labels)
    rows = out.join(labels, "doc_id").collect()
    for r in out.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.score, r.quality) for r in rows if r.held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([(s >= 0.5) == q for s, q in held]) > 0.93
    assert np.mean([s >= 0.5 for s in good]) > 0.97
    odd = quality_scores(frame(spark, ODD), labels.limit(0))
    assert odd.count() == len(ODD) and {r.score for r in odd.collect()} == {0.5}
    assert accepted(frame(spark, ODD), labels).columns == frame(spark, []).columns
    assert quality_scores(frame(spark, []), labels).count() == 0
    same = by_id(quality_scores(df.drop("lang", "source", "n_chars"), labels), "score")
    assert same == by_id(out, "score")


def test_prior_estimate():
    r = np.random.default_rng(0)
    p = r.normal(2, 1, 4000)
    u = np.concatenate((r.normal(2, 1, 2800), r.normal(-3, 1, 1200)))
    assert abs(estimate_prior(p, u) - 0.7) < 0.05


def test_words_match_plain_split():
    texts = [x or "" for x in ODD[:10]] + ["a\x0bb\x85c d"]
    for c in B.chunks(pa.array(texts), 64):
        w = B.words(c.data, c.offs, ~B.SPACE)
        got = [c.data[s:e].tobytes() for s, e in zip(w.start, w.end, strict=True)]
        assert got == [x for i in range(len(c.offs) - 1) for x in brute.WORD.findall(c.text(i))]


def pipeline_by_hand(docs):
    """What lines, near-duplicates and mixture leave of the documents, by plain versions of their contracts."""
    text = kept_of_all_lines(docs)
    was = dict(docs)
    left = [(i, t) for i, t in text.items() if t == was[i] or brute.WORD.search((t or "").encode())]
    return left, [i for i, *_, kept in brute.near(left, 5) if kept]


def test_pipeline_stages_equal_plain_ones(spark, sf):
    import corpus_pipeline

    df, docs = documents(spark, sf)
    left, kept = pipeline_by_hand(docs)
    out = corpus_pipeline.lines(spark, df, sf)
    assert {r.doc_id: r.text for r in out.collect()} == dict(left)
    out = C.written(out, "test-lines")
    near = C.written(corpus_pipeline.near_duplicates(spark, out, sf), "test-near")
    assert sorted(r.doc_id for r in near.collect()) == sorted(kept)
    sizes = {}
    for r in near.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text or "")
    whole, weight = sum(sizes.values()), sum(x**0.5 for x in sizes.values())
    want = {}
    for r in near.collect():
        rate = sizes[r.source] ** 0.5 * whole / (weight * sizes[r.source])
        parts, n = max(1, math.ceil(rate / 8)), 0
        for j in range(1, parts + 1):
            u = int(hashlib.md5(f"20:{r.doc_id}:{hashlib.md5((r.text or '').encode()).hexdigest()}:{j}".encode()).hexdigest()[:13], 16) / 2**52
            p = cdf = math.exp(-rate / parts)
            k = 0
            while u >= cdf and k < 60:
                k += 1
                p *= rate / parts / k
                cdf += p
            n += k
        if n:
            want[r.doc_id] = n
    mix = corpus_pipeline.mixture(spark, near, sf)
    got = {}
    for r in mix.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want


def test_pipeline_odd_rows(spark, sf):
    import corpus_pipeline

    for df in (frame(spark, [*ODD, *ODD], [None] * len(ODD) + list(range(len(ODD)))), frame(spark, [])):
        docs = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = C.written(stage(spark, docs, sf), "test-stage")
            assert docs.columns == df.columns
        out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert not out.filter("not roundtrip").count()


def test_pipeline(spark, sf):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*C.table(spark, sf, "documents").columns, "n_tokens", "ids", "roundtrip"]
    assert 50 < out.count() < 400 and not out.filter("not roundtrip").count()
