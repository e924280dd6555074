import random
import time
from collections import Counter

import duckdb
import pytest

from turnfold.operators import replay
from turnfold.operators import splitting as P
from turnfold.operators.splitting import RAW, digest
from turnfold.operators.store import Bloom
from turnfold.operators.turns import buckets
from turnfold.plans import queries
from turnfold.plans.registry import ORACLE_SQL, QUERIES
from turnfold.sources.tables import captures, table
from turnfold.streaming.presence import presence, requests, step

TABLES = ("orders", "customer", "events", "documents", "conversations")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    return str(round(x, 9) if isinstance(x, float) else x)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    have = sorted(tuple(plain(r[c]) for c in cols) for r in got.collect())
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    assert have == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in want.fetchall())


def test_known_totals(spark):
    r = QUERIES["replay_totals"](spark, "/root/testdata/sf0.01").first()
    assert (r.requests, r.split, r.refs, r.refs_hit, r.wire_split, r.body_split, r.body_all, r.inflated) == (536, 363, 1397, 939, 362_542, 921_626, 990_904, 0)
    assert not replay.may_inflate(replay.split_stats(table(spark, "/root/testdata/sf0.01", "conversations"))).count()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_self_checks(spark, sf):
    assert not QUERIES["structural_split"](spark, sf).filter("not identical").count()
    assert not QUERIES["codec_roundtrip"](spark, sf).filter("not same").count()
    assert not QUERIES["json_validate"](spark, sf).filter("not valid or cut").count()
    assert not QUERIES["bloom_membership"](spark, sf).filter("member and not found").count()
    s = QUERIES["stream_presence"](spark, sf).collect()
    assert sum(r.refs for r in s) == 1000 and sum(r.refs - r.refs_hit for r in s) == sum(r.pushed_bytes for r in s) // 100


def test_repairs_bring_every_body_back(spark, sf):
    rows = QUERIES["repair_protocol"](spark, sf).collect()
    assert len(rows) == 2 * QUERIES["structural_split"](spark, sf).count() and all(r.identical for r in rows)
    assert {r.outcome for r in rows} == {"whole", "split", "repaired", "resent whole"} and all((r.outcome == "repaired") <= (0 < r.repairs <= 4) for r in rows)
    assert all(r.identical and r.outcome == "split" for r in QUERIES["doctor"](spark, sf).collect())


def test_missing_closure_is_the_programs(spark, sf):
    p = P.Policy(min_body=0)
    blocks, programs, held = {}, {}, {}
    for r in queries._parts(spark, sf).collect():
        body = f'{{"model":"m","messages":[{r.note},{r.item}]}}'.encode()
        _, programs[r.seq], push, _ = P.Session(p).split(body)
        blocks |= push
        kinds = {(k, isinstance(b, bytes) and "user" in str(b[:20]) and b"note" in b[:40]): d for d, (k, _, b) in push.items()}
        want = {1: (P.MEMBER, False), 2: (P.MEDIA, False)}.get(r.seq % 3)
        if want in kinds:
            held[kinds[want]] = True
    got = {r.request: (r.blocks, r.bytes) for r in QUERIES["missing_closure"](spark, sf).collect()}
    want = {i: P.missing(held, x, known=blocks) for i, x in programs.items()}
    assert got == {i: (len(x), sum(blocks[d][1] for d in x)) for i, x in want.items()}


def test_chunks_are_of_every_document(spark, tmp_path):
    texts = [None, "", "a", "b" * 511, "c" * 4095, "words and more " * 700]
    got = QUERIES["cdc_chunks"](spark, documents(spark, tmp_path, [(i, t, "en", "a", None) for i, t in enumerate(texts)])).collect()
    ends = {i: max([r.end for r in got if r.doc_id == i], default=0) for i in range(len(texts))}
    assert ends == {i: len(t or "") for i, t in enumerate(texts)}
    assert sum(r.end - r.start for r in got) == sum(len(t or "") for t in texts)


def test_bucket_arithmetic(spark):
    rows = [(1, "a", "chat", 1000, 10, 5, 4, 3, 0, True), (2, "a", "chat", 1000, 20, 5, 3, 0, 0, True), (3, "b", "embeddings", 500, 480, 2, 1, 0, 0, True), (4, "b", "models", 100, 100, 0, 0, 0, 0, False)]
    t = spark.createDataFrame(rows, "seq long, profile string, path string, body long, wire long, refs long, refs_hit long, pushed long, repairs long, split boolean")
    got = buckets(t, t["path"]).collect()
    assert [r.key for r in got] == ["chat", "embeddings", "models"]
    assert (got[0].requests, got[0].body_bytes, got[0].wire_bytes, got[0].saved_bp, got[0].hit_bp) == (2, 2000, 30, 9850, 7000)


def test_captures(spark, tmp_path):
    for n, body in (("b.json", b"{ not"), ("a.json", b'{"messages":[]}'), ("c.txt", b"x")):
        (tmp_path / n).write_bytes(body)
    assert [bytes(r.body) for r in captures(spark, str(tmp_path)).orderBy("seq").collect()] == [b'{"messages":[]}', b"{ not"]


def documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_containment_has_documents_of_all_sizes(spark, tmp_path):
    texts = ["\n".join("é" * n for n in sizes) for sizes in ([10, 200, 199, 500], [1, 1000, 3, 250] * 7, [300, 0, 201])]
    rows = [(i, t, "en", "a", None if i == 2 else len(t)) for i, t in enumerate(texts)]
    want = []
    for i, t in enumerate(texts):
        spans, at = [], 0
        for line in t.split("\n"):
            spans.append((at, at + len(line)))
            at += len(line) + 1
        for cell in {a // 1000 for a, _ in spans}:
            inside = [x for x in spans if x[0] // 1000 == cell]
            oa, ob = min(a for a, _ in inside), max(b for _, b in inside)
            want += [(i, a, b, cell) for a, b in spans if b - a >= 200 and oa <= a and b <= ob]
    got = sorted(tuple(r) for r in QUERIES["payload_containment"](spark, documents(spark, tmp_path, rows)).select("doc_id", "a", "b", "cell").collect())
    assert got == sorted(want) and {i for i, *_ in got} == {0, 1, 2}


def test_short_documents_are_requests(spark, tmp_path):
    texts = [None, "", "short", "s" * 500, "", "t" * 501, "long words " * 200, "x", "short"] + ["w" * 5000] * 4
    folder = documents(spark, tmp_path, [(i, t, "en", "a", None if i == 3 or t is None else len(t)) for i, t in enumerate(texts)])
    rows = {r.seq: r for r in QUERIES["structural_split"](spark, folder).collect()}
    assert sorted(rows) == list(range(len(texts)))
    assert all((r.reason == "too_small") == (r.body_len < 1024) for r in rows.values())
    assert all(rows[i].reason == "too_small" for i in (0, 1, 2, 4, 7, 8)) and rows[6].reason is None and all(r.identical for r in rows.values())
    spans = QUERIES["nested_payload_split"](spark, folder).filter("span >= 0").collect()
    assert {r.seq for r in spans} >= {i for i in range(len(texts)) if i % 4}
    frames = QUERIES["zstd_frames"](spark, folder).collect()
    assert {r.peer: r.plain for r in frames} == {r.peer: sum(x.wire_frames for x in rows.values() if x.peer == r.peer) for r in frames}
    assert sum(r.plain for r in frames) == sum(r.wire_frames for r in rows.values())


def test_presence_is_of_earlier_conversations(spark, tmp_path):
    long = {k: f"{k} " * 600 for k in "abcd"}
    talks = {1: "ab", 2: "c", 3: "bad", 4: "d", 5: "cc", 6: ["b" * 200]}  # the last one is never split
    rows = [(c, t, "user", long.get(k, k)) for c, said in talks.items() for t, k in enumerate(said)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.known for r in QUERIES["presence_probe"](spark, str(tmp_path)).collect()}
    seen, want = {}, {}
    for c, said in sorted(talks.items()):
        for k in said:
            if seen.setdefault(k, c) != c:
                want[c] = want.get(c, 0) + 1
    assert got == want == {3: 2, 4: 1, 5: 2}


def test_replay_is_of_every_conversation(spark, tmp_path):
    """Long texts, short ones in numbers that the guard would turn away, texts that aren't JSON, none, and one long conversation."""
    talks = {1: ["a" * 5000, "b" * 200, "a" * 5000], 2: ["c%03d" % i * 30 for i in range(70)], 3: [None, "d\x01" * 700, None, "é" * 300], 4: [None, None], 5: [""], 6: ["b" * 200, "c000" * 30, "x" * 2000], 7: ["turn %d " % (i // 2) * 20 for i in range(300)]}
    rows = [(c, t, "user", x) for c, said in talks.items() for t, x in enumerate(said)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["replay_sequential"])
    names = [d[0] for d in want.description]
    assert QUERIES["replay_sequential"](spark, folder).first().asDict() == dict(zip(names, want.fetchone()))
    have = replay.replayed(table(spark, folder, "conversations")).collect()
    want = con.execute(ORACLE_SQL["split_stats"])
    names = [d[0] for d in want.description]
    want = {(r["conv_id"], r["turn"]): r for r in (dict(zip(names, x)) for x in want.fetchall())}
    assert {(r.conv_id, r.turn) for r in have} == set(want)
    for r in have:
        w = want[r.conv_id, r.turn]
        assert w["body_len"] is None and not r.split or r.asDict() == {c: w[c] for c in r.__fields__}  # SQL has no length where all is null


def test_replay_is_that_of_one_session_over_whole_bodies(spark):
    talk = table(spark, "/root/testdata/sf0.01", "conversations")
    session, want = P.Session(P.Policy(min_body=replay.MIN_BODY, cdc_fallback=False)), {}
    for r in replay.bodies(talk).orderBy("conv_id", "turn").collect():
        b = r.body.encode()
        reason, _, _, x = session.split(b)
        want[r.conv_id, r.turn] = (len(b), reason is None, x.refs, x.refs_hit, x.push_blocks, x.push_bytes, len(b) if reason else x.wire)
    have = replay.replayed(talk).collect()
    assert {(r.conv_id, r.turn): (r.body_len, r.split, r.refs, r.refs_hit, r.push_blocks, r.push_bytes, r.wire_model) for r in have} == want


def test_replay_is_dealt_by_conversation(spark, sf):
    plan = QUERIES["replay_sequential"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("MapInPandas") :]
    assert "RepartitionByExpression [conv_id" in below and "RepartitionByExpression [peer" not in plan


def test_stream_of_one_peer_is_not_one_loop(spark, tmp_path, sf):
    """Many events of one peer, and such as have no type, number or user."""
    folder, n = str(tmp_path), 200_000
    e = spark.range(n).selectExpr("id", "id % 1000 * 4 as user_id", "concat('t', id % 7) as event_type")
    odd = spark.createDataFrame([(-1, 8, None), (-2, None, "t1"), (-3, None, None), (None, 3, "t1"), (None, 3, "t1"), (None, 3, "t2"), (-4, 7, "")], "id long, user_id long, event_type string")
    like = table(spark, sf, "events")
    e = e.union(odd).withColumnRenamed("id", "event_id")
    e.selectExpr("event_id", "timestamp '2024-01-01' as ts", "user_id", "event_type", "1.5D as value", "'' as props").select(like.columns).write.parquet(f"{folder}/events.parquet")
    began = time.monotonic()
    got = {r.peer: (r.refs, r.refs_hit, r.pushed_bytes) for r in QUERIES["stream_presence"](spark, folder).collect()}
    assert time.monotonic() - began < 60
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    names = [d[0] for d in con.execute(ORACLE_SQL["stream_presence"]).description]
    want = [dict(zip(names, x)) for x in con.execute(ORACLE_SQL["stream_presence"]).fetchall()]
    assert got == {w["peer"]: (w["refs"], w["refs_hit"], w["pushed_bytes"]) for w in want} and len(got) == 3


def test_stream_knows_resets_and_earlier_batches(spark, tmp_path):
    rng, schema = random.Random(5), "peer string, seq long, digest string, len long, reset boolean"
    batches = []
    for b in range(4):
        batches.append([])
        for seq in rng.sample(range(b * 250_000, (b + 1) * 250_000), 60):
            peer = rng.choice(["a", "b", None])
            if rng.random() < 0.1:
                batches[-1].append((peer, seq, None, None, True))
            for d in rng.choices(["x", "y", "z", "u", "v", "w", None], k=rng.randint(0, 4)):
                batches[-1].append((peer, seq, d, d and ord(d), None if d == "x" else False))
    known, want = {}, {}
    for rows in batches:
        turns = {}
        for peer, seq, d, n, reset in rows:
            turns.setdefault((seq, peer), []).append((d, n, reset))
        for (seq, peer), turn in sorted(turns.items(), key=lambda x: x[0][0]):
            has = known.setdefault(peer, set())
            if any(r for _, _, r in turn):
                has.clear()
            refs = [(d, n) for d, n, r in turn if not r]
            new = {(d, n) for d, n in refs if d and d not in has}
            want[peer, seq] = (len(refs), sum(not d or d in has for d, _ in refs), len(new), sum(n for _, n in new))
            has |= {d for d, _ in new}
    at, made = str(tmp_path), []
    for n, rows in enumerate(batches):
        made.append(spark.createDataFrame(rows, schema))
        made[-1].coalesce(1).write.parquet(f"{at}/in/{n}")
        source = spark.readStream.schema(schema).parquet(f"{at}/in/*")
        presence(source, f"{at}/out").trigger(availableNow=True).start().awaitTermination()
    have = lambda: {(r.peer, r.seq): (r.refs, r.refs_hit, r.push_blocks, r.pushed_bytes) for r in requests(spark, f"{at}/out").collect()}
    assert have() == want and requests(spark, f"{at}/out").count() == len(want)
    step(made[-1], 3, f"{at}/out")  # a batch that runs again, as after a failure
    assert have() == want and requests(spark, f"{at}/out").count() == len(want)


def test_bloom_is_of_the_documents(spark, tmp_path):
    texts = [None if i == 7 else f"text {i // 3}" for i in range(3000)]
    folder = documents(spark, tmp_path, [(i, t, "en", "a", None) for i, t in enumerate(texts)])
    bloom, member = Bloom(1024), {t or "" for t in texts[::2]}
    for t in member:
        bloom.add(digest(RAW, t.encode()))
    want = Counter((t in member, digest(RAW, t.encode()) in bloom) for t in (x or "" for x in texts))
    assert {(r.member, r.found): r.n for r in QUERIES["bloom_membership"](spark, folder).collect()} == want
    rows = QUERIES["bloom_membership"](spark, documents(spark, tmp_path / "more", [(i, f"t{i}", "en", "a", None) for i in range(4000)])).collect()
    n = {(r.member, r.found): r.n for r in rows}
    assert n[True, True] == 2000 and (True, False) not in n and n.get((False, True), 0) < 60
