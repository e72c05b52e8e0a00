import hashlib
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("treeline.llm")
from treeline.llm import byte_bpe, exact_dedup, language_id, mixing, near_dedup, pii, telephony, toxicity, url_filter, warc  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, extra string, _size string"
WORDS = [f"w{i}" for i in range(60)]
LONG = " ".join(f"long{i % 997}x{i}" for i in range(30_000))
ROWS = [
    (1, " ".join(WORDS), "en", "a"), (2, " ".join(WORDS), "en", "a"), (3, " ".join([*WORDS[:-1], "zz"]).upper(), "en", "b"), (4, "", "en", "b"), (5, None, None, None), (6, " \t\n", "de", "c"), (7, "one two", "de", "c"),
    (8, "ONE  two", "de", "a"), (9, LONG, "fr", "a"), (10, LONG + " end", "fr", "b"), (7, "one two", "de", "c"), (None, "no id", "es", "b"), (12, "joe@example.org or +1 (555) 010-9999, 10.0.0.1 é 4111 1111 1111 1111", "es", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "y") for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_near_classes(docs, empty):
    got = {(r.doc_id, r.n_shingles): r for r in near_dedup.near_classes(docs, 5, 85).collect()}
    by = {k[0]: r for k, r in got.items()}
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1 and not by[2].kept and by[1].n_shingles == 56
    assert by[4].n_shingles == by[5].n_shingles == by[6].n_shingles == 0 and by[4].kept and by[6].component_id == 6
    assert by[7].component_id == by[8].component_id == 7 and by[9].component_id == by[10].component_id == 9
    kept = [r.doc_id for r in near_dedup.near_dedup(docs, 5, 85).collect()]
    assert sorted(kept, key=str) == sorted([1, 4, 5, 6, 7, 9, 12, None], key=str)
    assert near_dedup.near_classes(empty).count() == 0


def test_near_classes_equal_all_pairs(spark):
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(12):
        base = rng.choice(WORDS, 40).tolist()
        for _ in range(8):
            text = list(base)
            for _ in range(int(rng.integers(0, 4))):
                text[rng.integers(40)] = f"x{rng.integers(9)}"
            rows.append((len(rows), " ".join(text)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(36)} for _, t in rows]
    least = list(range(len(rows)))
    for i, j in [(i, j) for i in least for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]:
        low, high = sorted((least[i], least[j]))
        least = [low if x == high else x for x in least]
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == {i: (least[i], least[i] == i) for i in range(len(rows))} and 12 < len(set(least)) < len(rows)


def test_estimates_lie_near_similarity():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    other = np.concatenate([base[:1800], rng.integers(0, 2**63, 200, dtype=np.uint64)])
    a, b = (near_dedup.pack(near_dedup.minima(x)[None, :])[0].view(np.uint64) for x in (base, other))
    differ = sum(bin(int((x ^ y) | (x ^ y) >> np.uint64(1)) & 0x5555555555555555).count("1") for x, y in zip(a, b))
    assert abs(((1 - differ / 128) - 0.25) / 0.75 - 1800 / 2200) < 0.2


def test_exact_classes(docs, empty):
    got = {}
    for r in exact_dedup.exact_classes(docs).collect():
        got.setdefault(r.doc_id, r)
    assert got[2].keep_id == 1 and got[2].group_size == 2 and not got[2].kept
    assert got[4].keep_id == got[5].keep_id == 4 and got[6].keep_id == 6 and got[7].group_size == 2 and got[8].keep_id == 8
    assert got[8].text_sha256 == hashlib.sha256(b"ONE two").hexdigest() and got[None].kept
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == 10 and exact_dedup.exact_classes(empty).count() == exact_dedup.exact_dedup(empty).count() == 0
    for values in ([], [5], [0, 2**64 - 1], sorted(np.random.default_rng(1).integers(0, 2**64 - 1, 500, dtype=np.uint64).tolist())):
        assert exact_dedup.rice_decode(exact_dedup.rice_encode(np.array(values, np.uint64))).tolist() == values


def test_byte_bpe_equals_the_library(docs, empty):
    import tiktoken

    path, pattern = byte_bpe.vocabulary()
    ranks = byte_bpe.load_ranks(path)
    want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(2)
    texts = ["", "a" * 3000, " \n\n  x", "don't 12 中😀", LONG[:9000]] + ["".join(rng.choice(list("abehint  é0.\n"), 200)) for _ in range(50)]
    frame = docs.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in byte_bpe.encode(frame, path, pattern).collect():
        assert r.ids == want.encode_ordinary(texts[r.doc_id])
    got = {r.doc_id: r for r in byte_bpe.token_digests(frame, path, pattern).collect()}
    for i, text in enumerate(texts):
        ids = want.encode_ordinary(text)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) and got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    encoded = byte_bpe.encode(docs, path, pattern)
    back = byte_bpe.decode(encoded, path).collect()
    assert encoded.columns == [*docs.columns, "ids"] and len(back) == len(ROWS) and all(bytes(r.bytes) == (r.text or "").encode() for r in back)
    assert byte_bpe.token_digests(docs, path, pattern).count() == len(ROWS) and byte_bpe.token_digests(empty, path, pattern).count() == 0


def _plain_merges(word, ranks):
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def test_merges_that_open_lower_ranks():
    ranks = {bytes([i]): i for i in range(256)} | {b"bc": 256, b"abc": 257, b"ab": 300, b"cd": 301, b"abcd": 258, b"aa": 302, b"aaa": 259}
    merges = byte_bpe.Merges(ranks)
    rng = np.random.default_rng(5)
    words = [b"abcd", b"abab", b"abcabc", b"a", b"", b"bcd", b"aaaaaaa", *(bytes(rng.choice(list(b"abcd"), 40).tolist()) for _ in range(200))]
    ids, at = merges.replay(words)
    want = [_plain_merges(w, ranks) for w in words]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want == [byte_bpe._alone(w, ranks) for w in words]


def test_telephony(docs, empty, spark):
    rows = telephony.media_facts(telephony.store_audio(docs)).collect()
    for r, (doc_id, text, *_) in zip(sorted(rows, key=lambda r: str(r.doc_id)), sorted(ROWS, key=lambda r: str(r[0])), strict=True):
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) == (doc_id, len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.pcm_bytes == 4 * len(payload) and r.payload_bytes == len(payload)
    media = [telephony.wav(bytes(range(72)), k, 8000, b) for k, b in ((telephony.MULAW, 1), (telephony.ALAW, 1), (telephony.ADPCM, 36))] + [b"no", None]
    out = telephony.decode_media(spark.createDataFrame([(m,) for m in media], "media binary")).collect()
    kinds = [None if r.media is None else telephony.read_wav(bytes(r.media))[:2] for r in out]
    assert kinds == [(1, 16000)] * 3 + [None, None] and telephony.media_facts(telephony.store_audio(empty)).count() == 0
    assert telephony.MULAW_TABLE[[0, 127, 255]].tolist() == [-32124, 0, 0] and telephony.ALAW_TABLE[[0x55, 0xD5]].tolist() == [-8, 8]


def test_personal_data(docs, empty, spark):
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}[12]
    assert (got.n_email, got.n_ip, got.n_card, got.n_phone) == (1, 1, 1, 1)
    text = ROWS[-1][1]
    want = [(k, text.index(x), text.index(x) + len(x)) for k, x in (("email", "joe@example.org"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 010-9999"))]
    assert got.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in want) and pii.personal_data(empty).count() == 0
    texts = [f"login from host 10.0.0.{i} ok" for i in range(20)] + ["login from host 10.0.0.999 ok", "a clean text 12"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    more = {r.doc_id: r.spans for r in pii.personal_data(frame).collect()}
    assert more[0] == "ip:16:24" and more[20] == "ip:16:26" and more[21] == ""
    clean = pii.redacted(docs)
    assert clean.columns == docs.columns and {r.doc_id: r.text for r in clean.collect()}[12] == "[email] or [phone], [ip] é [card]"


def test_personal_data_of_other_shapes(spark):
    seeds = [f"my phone number is +1-555-010-{1000 + i} thanks" for i in range(40)] + [f"write me at user{i}@host{i}.org please" for i in range(40)]
    seeds += [f"paid by card 4111 1111 1111 1111 ref{i}" for i in range(3)] + [f"+1 555 010 {2000 + i} is mine" for i in range(20)] + [f"{i} 10.0.0.{i} up" for i in range(20)]
    new = {"phone": ["555-010-9999", "555 010 9999", "(555) 010 9998"], "email": ["user[at]host1.org", "user[at]host.org"]}
    lines = {"phone": "my phone number is {} thanks", "email": "write me at {} please"}
    rows = [(lines[k].format(x), k, x) for k, xs in new.items() for x in xs] + [("555 010 7777 is mine", "phone", "555 010 7777"), ("12 10.0.0.999 up", "ip", "10.0.0.999")]
    texts = seeds + [t for t, *_ in rows] + ["chapter 12 of 40", "in 1999 2000 people"]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = [f"{k}:{t.index(x)}:{t.index(x) + len(x)}" for t, k, x in rows]
    assert [got[len(seeds) + i] for i in range(len(rows))] == want and got[len(texts) - 1] == got[len(texts) - 2] == ""


def test_mixing(docs, empty, spark):
    import random

    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 30))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(frame).collect()
    total = sum(r.size for r in got)
    for s in ("a", "b", "c", None):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 30 and mine[0].target <= 3 * mine[0].source_size + 1e-6
        assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in mine)
    assert abs(sum({r.source: r.target for r in got}.values()) - total) < 1e-6
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(frame.repartition(7)).collect()))
    assert mixing.mix(frame).count() == sum(r.repeats for r in got) and mixing.mixed(empty).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.repeats for r in mixing.mixed(docs).collect())


def test_url_verdicts(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "https://a.example.org/es/x", ""), (2, "http://EXAMPLE.org/en/12?q", ""), (3, "http://net.example/a", link.format("http://b.com/de/1")), (4, "http://net.example/b", '<meta http-equiv="refresh" content="0; url=/a">'),
        (5, "http://b.com/fr/", link.format("http://b.com/de/1")), (6, None, None), (7, "nothing", ""), (8, "x://h", ""), (9, "http://net.example/c#f", ""),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[2][2:] == ("example.org/en/1", "block")
    assert got[3][2:] == got[4][2:] == (None, "block") and got[5][2:] == ("com/fr/", "allow")
    assert got[6] == got[7] == ("", "", None, "allow") and got[8][:2] == ("h", "") and got[9] == ("net.example", "/c", None, "allow")
    assert url_filter.url_verdicts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc(spark):
    rows = [(1, "u1", "same"), (2, "u\n2", "same"), (3, None, None), (4, "u", ""), (None, "n", "same"), (5, "v", "é" * 100_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    records = warc.read_archives(warc.write_archives(frame))
    got = {r.page_id: r for r in records.collect()}
    assert got[1].record_type == "revisit" and got[1].refers_to == 2 and got[2].record_type == "response" and got[3].refers_to == 4
    assert got[None].refers_to == 2 and got[5].payload_bytes == 200_000 and got[1].payload_bytes == 4
    assert {r.page_id: bytes(r.payload) for r in warc.resolved(records).collect()}[1] == b"same"
    assert all(r.record_type == "response" for r in warc.read_archives(warc.write_archives(frame, least_bytes=5)).collect())
    assert warc.read_archives(warc.write_archives(frame.limit(0))).count() == 0


def _chain(scores, moves):
    a = np.array([1.0, 0.0])
    left = []
    for s in scores:
        a = (a @ moves) * [1, np.exp(s)]
        a /= a.sum()
        left.append(a)
    b, out = np.ones(2), []
    for s, a in zip(scores[::-1], left[::-1]):
        out.append((a * b)[1] / (a * b).sum())
        b = moves @ (b * [1, np.exp(s)])
        b /= b.sum()
    return out[::-1]


def test_toxicity(spark, docs):
    rng = np.random.default_rng(0)
    moves, sizes = np.array([[1.0, 0.2], [0.5, 0.7]]), [0, 3, 200, 64, 1, 500]
    scores, rows = rng.normal(size=sum(sizes)), np.concatenate([[0], np.cumsum(sizes)])
    want = np.concatenate([_chain(scores[a:b], moves) for a, b in zip(rows[:-1], rows[1:]) if b > a])
    assert np.allclose(toxicity.marginals(moves, scores, rows), want, atol=1e-9)
    words = [f"v{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(400):
        t = list(rng.choice(words, 60))
        if i % 4 == 0:
            t[rng.integers(60)] = "nasty"
            t[rng.integers(60)] = "awful"
        texts.append(" ".join(t))
        labels.append(int(i % 4 == 0))
    model = toxicity.fit(texts, np.array(labels), np.ones(400))
    frame = spark.createDataFrame([(0, "v1 v2 nasty v3"), (1, "v1 v2 v3 v4"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.tag(frame, model).collect()}
    assert got[0].score > 0.5 > got[1].score and got[0].offsets == "6:11" and got[2].score == got[3].score < 0.5
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    none = toxicity.train(frame.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score < 0.3 for r in toxicity.tag(frame, none).collect())


def test_language(spark, empty):
    rng = np.random.default_rng(1)
    parts = {"en": "the ing tion and er".split(), "de": "sch ung der keit ein".split()}
    rows = [(i, " ".join("".join(rng.choice(parts[k], 2)) for _ in range(30)), k) for i, k in enumerate(["en", "de"] * 60)]
    frame = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 34 !", "de"), (902, "x" * 5000, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predict(frame, language_id.train(frame)).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.95 and got[900].lang_pred == got[901].lang_pred == "und"
    assert 0 <= got[902].score <= 1 and language_id.predict(empty, language_id.train(empty)).count() == 0


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "STEPS", 60)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rows = [(i, "word text", f"l{i % 69}") for i in range(69 * 6)] + [(1000 + i, "rare one", "rare") for i in range(3)]
    assert language_id.train(frame(rows)).names == sorted({k for *_, k in rows})
    rng = np.random.default_rng(1)
    parts = {"en": ("the ing tion and er".split(), 30, ""), "de": ("sch ung der keit ein".split(), 1500, "1" * 6000 + " ")}
    rows = [(i, parts[k][2] + " ".join("".join(rng.choice(parts[k][0], 2)) for _ in range(parts[k][1])), k) for i, k in enumerate(["en", "de"] * 20)]
    got = {r.doc_id: r.lang_pred for r in language_id.predict(frame(rows), language_id.train(frame(rows))).collect()}
    assert np.mean([got[i] == k for i, _, k in rows]) > 0.95
    monkeypatch.setattr(language_id, "BATCH", 4)
    texts = [np.frombuffer(bytes([97 + k] * 40), np.uint8) for k in range(10)]
    model = language_id.fit(texts, np.arange(10), [str(k) for k in range(10)])
    sums, n = language_id.pooled(model, np.concatenate(texts), np.arange(11) * 40)
    assert len(model.names) == 10 and sums.argmax(axis=1).tolist() == list(range(10)) and np.allclose(sums.sum(axis=1), n)


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and all(r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest() for r in out)
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        columns = kept.columns
        kept = stage(spark, kept, folder)
        assert kept.columns == columns
    squeezed = [re.sub(r"[ \t-\r]+", " ", r.text or "") for r in kept.dropDuplicates(["doc_id"]).collect()]
    assert len(squeezed) == len(set(squeezed))
