import random

import pytest

from turnfold.functions import cdc, codec
from turnfold.functions import jsonscan as J
from turnfold.functions.blake3 import blake3
from turnfold.operators import splitting as P
from turnfold.operators.link import Link, Peer
from turnfold.operators.store import Blocks, Bloom, Store
from turnfold.sources.tables import Config, Profile, load_config


def test_blake3_published_vectors():
    assert blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3(b"abc").hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    data = bytes(i % 251 for i in range(2049))
    assert blake3(data[:1025]).hex().startswith("d00278ae47eb27b3")
    assert blake3(data[:2049]).hex().startswith("5f4d72f40d7a5f82")


@pytest.mark.parametrize("text", ['{"a":1} ', "{}", '{"a":01}'])
def test_scanned(text):
    J.scan_document(text.encode())


@pytest.mark.parametrize("text", ['{"a":1}x', '"str"', "[]", "[1,2,3]", "{", ""])
def test_not_scanned(text):
    with pytest.raises(J.ScanError):
        J.scan_document(text.encode())


@pytest.mark.parametrize("text", ['{"a":01}', '{"a":1,}', '{"a"}', '{"a":{"b":[1,,2]}}', '{"a":"\\ud800"}'])
def test_not_valid(text):
    assert not J.valid(text.encode())


@pytest.mark.parametrize("text", ['"\\u12"', "-", "1e", "[1", "{]", "tru"])
def test_no_value(text):
    with pytest.raises(J.ScanError):
        J.scan_value(text.encode(), 0)


def test_scanner_details():
    assert J.valid(b'{"a":1,"b":{"c":"x"}}')
    odd = b"{(}"
    with pytest.raises(J.ScanError):
        J.members(odd, J.scan_value(odd, 0))
    b = b'{"a":"]}{[","b":[1, {"c":2}]}'
    assert [m.key for m in J.members(b, J.scan_document(b))] == ["a", "b"]
    assert J.decode_string(b'"\\ud83d\\ude00\\n"') == "\U0001f600\n"
    with pytest.raises(J.ScanError):
        J.decode_string(b'"\\udc00"')
    J.scan_value(b"[" * 128 + b"]" * 128, 0)
    with pytest.raises(J.ScanError):
        J.scan_value(b"[" * 129 + b"]" * 129, 0)


def test_chunks_tile_and_stay_local():
    data = bytes((i * 7 + i // 1000) & 255 for i in range(200_000))
    got = cdc.cuts(data, 4096, 65536, 13)
    assert got[0][0] == 0 and got[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    assert all(4096 <= e - s <= 65536 for s, e in got[:-1])
    r = random.Random(1)
    noise = r.randbytes(120_000)
    other = noise[:40_000] + b"inserted" + noise[40_000:]
    parts = lambda b: {b[s:e] for s, e in cdc.cuts(b, 2048, 32768, 12)}
    assert len(parts(noise) & parts(other)) >= len(parts(noise)) - 3
    assert cdc.cuts(b"k" * 40_000, 8 << 10, 128 << 10, 15) and cdc.cuts(b"", 1, 2, 3) == []
    h, start, want = 0, 0, []
    for i, x in enumerate(noise):  # a byte at a time
        h = (h * 2 + int(cdc.gear()[x])) & (1 << 64) - 1
        n = i + 1 - start
        if n >= 2048 and (h & 4095 == 0 or n >= 32768):
            want.append((start, i + 1))
            start = i + 1
    assert cdc.cuts(noise, 2048, 32768, 12) == [*want, (start, len(noise))]


def test_codec():
    for n in (0, 1, 127, 128, 16383, 16384, 2**32 - 1, 2**64 - 1):
        assert codec.get_varint(codec.put_varint(n), 0) == (n, len(codec.put_varint(n)))
    for bad in (b"\x80", b"\xff" * 11, b"\xff" * 9 + b"\x02"):
        with pytest.raises(ValueError):
            codec.get_varint(bad, 0)
    program = [b"abc", (b"d" * 16, 300), b""]
    raw = codec.encode_program(program)
    assert codec.decode_program(raw) == program
    with pytest.raises(ValueError):
        codec.decode_program(raw + b"x")
    nested = codec.encode_block(b"e" * 16, 1, 9, program)
    assert codec.decode_block(nested) == (b"e" * 16, 1, 9, program)
    assert codec.decode_digests(codec.encode_digests([b"a" * 16, b"b" * 16])) == [b"a" * 16, b"b" * 16]
    text = b'{"role":"user"}' * 100
    assert codec.decompress(codec.compress(text)) == text
    assert codec.compress(b"x" * 511) is None and codec.compress(random.Random(0).randbytes(4000)) is None
    import zstandard

    with pytest.raises(ValueError):
        codec.decompress(zstandard.compress(bytes((64 << 20) + 10)))


def value(r, depth):
    pick = r.random()
    if depth < 3 and pick < 0.35:
        names = ["messages", "tools", "url", "file_data", "data", "input", "k" + str(r.randint(0, 9))]
        return "{" + ",".join(f'"{r.choice(names)}"{" " * r.randint(0, 1)}:{value(r, depth + 1)}' for _ in range(r.randint(0, 6))) + "}"
    if depth < 3 and pick < 0.6:
        return "[" + " , ".join(value(r, depth + 1) for _ in range(r.randint(0, 5))) + "]"
    if pick < 0.85:
        return '"' + r.choice(["x", "é", "\\u00e9", "\\ud83d\\ude00", "\\n", "data:"]) * r.randint(0, 900) + '"'
    return r.choice(["-0.0", "1e10", "123456789012345678901234567890", "0.0000000001", "true", "null"])


def test_identity_of_random_bodies():
    split = 0
    for seed in range(400):
        r = random.Random(seed)
        policy = P.Policy(min_body=512, min_block=r.choice([64, 384, 2048]), min_payload=1024, cdc_min=512, cdc_max=4096, cdc_bits=6)
        body = ("{" + ",".join(f'"{r.choice(["messages", "tools", "other", "prompt"])}":{value(r, 0)}' for _ in range(r.randint(2, 7))) + "}").encode()
        session, peer = P.Session(policy), {}
        for b in (body, body, body[: len(body) // 2] + b"!!" + body[len(body) // 2 :]):
            reason, program, push, s = session.split(b)
            peer |= push
            assert P.resolve(peer, program) == b
            if reason is None:
                split += 1
                assert s.lit_bytes + s.ref_covered == len(b)
                assert not P.missing(peer, program)
                assert abs(P.wire_frames(program, push) - s.wire) <= 64 + 32 * (s.instrs + s.push_blocks)
    assert split > 300


def chat(turns, image=60_000):
    r = random.Random(7)
    out = ['{"role":"system","content":"' + "be brief " * 60 + '"}']
    for t in range(turns):
        url = ',{"type":"image_url","image_url":{"url":"data:image/jpeg;base64,' + "".join(r.choice("ABCDabcd0123") for _ in range(image)) + '"}}' if t % 3 == 0 else ""
        out.append('{"role":"user","content":[{"type":"text","text":"turn ' + str(t) + " " + "more words " * 20 + '"}' + url + "]}")
    tools = "[" + ",".join('{"type":"function","function":{"name":"f%d","description":"%s"}}' % (i, "long text " * 20) for i in range(12)) + "]"
    return ('{"model":"m","messages":[' + ",".join(out) + '],"tools":' + tools + "}").encode()


def test_savings_of_a_conversation():
    session, blocks = P.Session(), {}
    for t in range(1, 13):
        body = chat(t)
        reason, program, push, s = session.split(body)
        blocks |= push
        assert reason is None and P.resolve(blocks, program) == body
    assert len(body) > 200_000 and s.wire < 6_000 and s.wire * 50 < len(body)


def test_programs():
    d, e = b"d" * 16, b"e" * 16
    blocks = {d: (P.MEDIA, 12, b"m" * 12), e: (P.MEMBER, 16, [b"<<", (d, 12), b">>"])}
    assert P.resolve(blocks, [b"a", (e, 16), b"z"]) == b"a<<" + b"m" * 12 + b">>z"
    assert P.missing({e: blocks[e]}, [(e, 16), (d, 12), (d, 12)]) == [d] and P.missing({}, [(d, 12), (e, 16)]) == [e, d]
    for bad, why in (([(b"x" * 16, 1)], "missing"), ([(d, 11)], "corrupt")):
        with pytest.raises(P.Rebuild, match=why):
            P.resolve(blocks, bad)
    with pytest.raises(P.Rebuild, match="too_large"):
        P.resolve(blocks, [(e, 16)], most=10)
    with pytest.raises(P.Rebuild, match="too_deep"):
        P.resolve(blocks, [(e, 16)], depth=1)
    assert P.normal([b"a", b"", b"b", (d, 12), b""]) == [b"ab", (d, 12)]
    for body in (b"x" * 20_000, b"[1,2,3]", b"{", b"", b'{"messages":"no"}'):
        assert P.resolve({}, P.Session(P.Policy(cdc_fallback=False)).split(body)[1]) == body
    assert P.Session().split(b"k" * 9000)[0] is None


def test_missing_set_of_nested_programs():
    d, e, f = b"d" * 16, b"e" * 16, b"f" * 16
    known = {d: (P.MEDIA, 3, b"mmm"), e: (P.MEMBER, 6, [(d, 3), b"-", (d, 3)]), f: (P.MEMBER, 6, [(e, 6)])}
    assert P.missing({}, [(f, 6), (e, 6)], known=known) == [e, d, f] and P.missing({}, [(f, 6)], known=known) == [f, e, d]
    assert P.missing({f: known[f]}, [(f, 6), (d, 3)], known=known) == [d] and P.missing({d: known[d]}, [(f, 6)], known=known) == [f, e]
    assert P.missing({}, [(f, 6)], limit=2, known=known) == [f, e] and P.missing({}, [(f, 6)]) == [f] and P.missing({}, [b"x"]) == []


def test_frames_say_what_they_are():
    assert [int(codec.Tag[n]) for n in ("HELLO", "PROGRAM", "NEED", "END_OF_BODY", "FAIL", "REQUEST_BODY_Z")] == [1, 4, 7, 17, 19, 23] and len(codec.Tag) == 23 and len(codec.PACKED) == 4
    with pytest.raises(ValueError):
        codec.decode_frames(codec.encode_frame(24, 1, b""))
    long = b'{"role":"user"}' * 100
    tag, raw = codec.upload(codec.Tag.PROGRAM, long, True)
    assert tag == codec.Tag.PROGRAM_Z and len(raw) < len(long) and codec.received(tag, raw) == (codec.Tag.PROGRAM, long)
    for given in ((codec.Tag.PROGRAM, long, False), (codec.Tag.PROGRAM, b"short", True), (codec.Tag.RESPONSE_BODY, long, True)):
        assert codec.upload(*given) == given[:2] == codec.received(*given[:2])
    said = {"version": 2, "ok": False, "reason": None, "peer_name": "é"}
    assert codec.encode_control(said) == '{"version":2,"ok":false,"peer_name":"é"}'.encode() and codec.decode_control(codec.encode_control(said)) == {k: v for k, v in said.items() if v is not None}
    for bad in (b"nope", b"[1]"):
        with pytest.raises(ValueError):
            codec.decode_control(bad)
    bloom = Bloom(100).to_bytes()
    assert codec.decode_bloom(codec.encode_bloom(3, 300, bloom)) == (3, 300, bloom)


def test_link_repairs():
    body = chat(9)
    link = Link()
    first = link.send(body)
    again = link.send(body)
    assert (first.outcome, again.outcome) == ("split", "split") and first.body == again.body == body and again.wire < 2_000 < 50_000 < first.wire
    whole = len(link.peer.blocks)
    assert link.peer.reset() == whole
    # the peer starts anew and asks again: for the program's blocks, then for each of the three images inside them
    third = link.send(body)
    assert (third.outcome, third.repairs, third.resent, third.body) == ("repaired", 4, whole, body) and len(link.peer.blocks) == whole
    # what the sender lost too can't come again: whole, and nothing is taken as noted any more
    link.peer.reset(), link.known.clear()
    lost = link.send(body)
    assert (lost.outcome, lost.reason, lost.repairs, lost.body) == ("resent whole", "rebuild failed", 4, body) and not link.session.noted
    assert link.send(body).outcome == "split"
    # a block that isn't what it is named for
    d = next(d for d, (_, _, b) in link.peer.blocks.items() if isinstance(b, bytes))
    kind, n, b = link.peer.blocks[d]
    link.peer.blocks[d] = (kind, n, b[::-1])
    spoilt = link.send(body)
    assert (spoilt.outcome, spoilt.repairs, spoilt.body) == ("resent whole", 0, body) and link.session.noted
    small = link.send(b"{}")
    assert (small.outcome, small.reason, small.body, small.wire) == ("whole", "too_small", b"{}", 2 + 2 * codec.FRAME_COST)


def test_link_of_random_bodies():
    outcomes = set()
    for seed in range(60):
        r = random.Random(seed)
        policy = P.Policy(min_body=512, min_block=64, min_payload=1024, cdc_min=512, cdc_max=4096, cdc_bits=6)
        link = Link(P.Session(policy), Peer(Store(max_bytes=r.choice([30_000, 300_000]), max_blocks=r.choice([12, 600]), max_block=200_000, ttl=0)), compress=bool(seed % 2))
        bodies = [("{" + ",".join(f'"{r.choice(["messages", "tools", "other", "prompt"])}":{value(r, 0)}' for _ in range(r.randint(2, 7))) + "}").encode() for _ in range(6)]
        for b in bodies * 3:
            if r.random() < 0.2:
                link.peer.reset()
            x = link.send(b)
            outcomes.add(x.outcome)
            assert x.body == b and x.repairs <= 4 and set(link.peer.blocks) == set(link.peer.store.entries)
    assert outcomes == {"whole", "split", "repaired", "resent whole"}


def test_unbounded_blocks():
    b = Blocks()
    assert b.put(b"a", 0, 3, b"xyz") and not b.put(b"a", 0, 4, b"wxyz") and b.put(b"c", 1, 2, [b"no"])
    assert (len(b), b.bytes, b"a" in b, b[b"a"][2], b.get(b"z")) == (2, 6, True, b"wxyz", None) and b.remove(b"a", b"z") == 1 and b.bytes == 2


def test_store_and_bloom():
    s = Store(max_bytes=10_000, max_block=5_000)
    assert s.insert("a", 4000, 1) and s.insert("b", 3499, 2)
    s.touch("a", 3)
    assert s.insert("c", 4000, 4) and set(s.entries) == {"a", "c"} and s.evictions == 1
    assert not s.insert("d", 6000, 5) and not s.insert("a", 4000, 5) and not s.insert("e", 1, 5, sound=False) and s.rejected == 2
    assert s.get("a", 6) and not s.get("b", 6) and (s.hits, s.misses) == (1, 1) and s.clear() == 2 and s.size == 0
    old = Store(max_bytes=10, ttl=5)
    old.insert("a", 4, 0), old.insert("b", 4, 8), old.insert("c", 4, 9)
    assert set(old.entries) == {"c"}  # a expires, and b makes room: expired bytes do not count
    b = Bloom(10_000)
    name = lambda i: P.digest(0, str(i).encode())
    for i in range(500):
        b.add(name(i))
    b = Bloom.from_bytes(b.to_bytes())
    assert all(name(i) in b for i in range(500)) and sum(name(i) in b for i in range(1000, 2000)) < 10
    for bad in (b"", b.to_bytes()[:-1], bytes(12)):
        with pytest.raises(ValueError):
            Bloom.from_bytes(bad)


def test_config(tmp_path):
    (tmp_path / "a.json").write_text('{"min_body": 7, "unknown": 1}')
    (tmp_path / "a.toml").write_text('min_body = 8\ntoken = "0123456789abcdef"\n')
    assert load_config(str(tmp_path / "a.json")).min_body == 7 and load_config(str(tmp_path / "a.toml")).min_body == 8
    (tmp_path / "b.toml").write_text('[[profiles]]\nname = "a"\nlisten = ":1"\npeer = ":2"\nother = 1\n')
    assert load_config(str(tmp_path / "b.toml")).profiles == (Profile("a", ":1", ":2"),)
    one = Profile("a", ":1", ":2")
    Config(profiles=(one, Profile("b", ":3", ":2", True, "ca.der"))).check(), Config(role="remote", enabled=False, upstream="https://x").check()
    bad = [{"token": "short"}, {"role": "x"}, {"max_block": 1 << 40}, {"enabled": False}, {"role": "remote", "upstream": "ftp://x"}, {"role": "remote", "tls": True}]
    for given in [*bad, {"profiles": (Profile("a", ":1", ":1"),)}, {"profiles": (one, one)}, {"profiles": (Profile("a", ":1", ":2", True),)}]:
        with pytest.raises(ValueError):
            Config(**given).check()
