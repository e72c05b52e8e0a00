"""Operators against plain versions, on whole tables."""

import datetime
import hashlib
import re
import zlib
from fractions import Fraction
from urllib.parse import urljoin

import numpy as np
import pytest

pytest.importorskip("treeline.llm")
from pyspark.sql import functions as F  # noqa: E402
from treeline.llm import byte_bpe, components, exact_dedup, language_id, mixing, near_dedup, pii, telephony, toxicity, url_filter, warc  # noqa: E402
from treeline.llm._sampling import first_rows, place, sampled  # noqa: E402
from treeline.llm._store import Blocks, with_facts  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def _shingles(text, width=5):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def _classes(rows, percent):
    """doc_id to the least id reachable by links of all pairs."""
    sets, least = {i: _shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    for i, j in {(i, j) for ids in by.values() for i in ids for j in ids if j < i}:
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((root(i), root(j)))
            least[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_classes_of_a_table(spark, table):
    rows = [(r.doc_id, r.text) for r in table.collect()]
    base = [f"b{i}" for i in range(120)]
    rng = np.random.default_rng(9)
    for k in range(400):  # one large cluster of different texts, and a cloud whose members mostly don't link
        text = list(base)
        text[int(rng.integers(120))] = f"c{k}"
        if k >= 200:
            text = text[:90] + [f"d{k % 20}x{i}" for i in range(int(rng.integers(20, 40)))]
        rows.append((100_000 + k, " ".join(text)))
    want = _classes(rows, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), 5, 85).collect()}
    linked = [i for i in want if want[i][1] != i]
    assert sum(got[i] == want[i] for i in linked) == len(linked) > 250 and got == want


def test_texts_of_many_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "COPY_PAIRS", 3)
    base = [f"b{i}" for i in range(100)]
    rows = [(k, " ".join([*base[:k], f"c{k}", *base[k + 1 :]])) for k in range(40)] + [(50, " ".join(base))]
    got = {r.doc_id: r.component_id for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == {i: c for i, (_, c) in _classes(rows, 80).items()} and set(got.values()) == {0}


def test_components_of_a_hub(spark):
    leaves = spark.range(100_000).select((F.col("id") + 10).alias("u"), F.lit(7).cast("long").alias("v"))
    chain = spark.createDataFrame([(5, 3), (3, 2), (9, 9), (None, 1), (2, 1), (1, 2), (7, 6)], "u long, v long")
    got = components.connected_components(leaves.union(chain))
    assert got.where("node >= 6").agg(F.count("*"), F.min("root"), F.max("root")).first()[:] == (100_002, 6, 6)
    assert sorted((r.node, r.root) for r in got.where("node < 6").collect()) == [(1, 1), (2, 1), (3, 1), (5, 1)]


def test_frequent_keys_join_by_broadcast(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    facts = rows.where("id % 2 = 0 or k = 'hot'").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    plain = rows.join(facts, "k", "left")
    got = with_facts(rows, facts, "k", "n", 20_000, "left")
    assert got.count() == 20_000 and got.exceptAll(plain.select(got.columns)).count() == 0
    inner = with_facts(rows, facts, "k", "n", 20_000)
    assert inner.exceptAll(rows.join(facts, "k").select(inner.columns)).count() == 0 and inner.count() < 20_000


def test_samples_are_bounded_and_stable(spark):
    ids = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, 1).otherwise(0).alias("label"))
    take = lambda df: [(r.doc_id, r.label) for r in first_rows(sampled(df, "label", 400).withColumn("place", place()).collect(), "label", 400)]
    got = take(ids)
    assert got == take(ids.repartition(7)) and [sum(k == x for _, k in got) for x in (0, 1)] == [400, 400]
    assert sampled(ids, "label", 400).count() < 1300
    plan = sampled(ids, "label", 400)._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_suspects_alone_are_shuffled(spark, table):
    packed = table.select(F.struct("*").alias("row"))
    blocks, groups, total = exact_dedup._groups(table)
    found = exact_dedup.suspects(blocks, 4)
    texts = [r.text for r in table.collect()]
    normal = [exact_dedup.normal(t) for t in texts]
    twice = {t for t in normal if normal.count(t) > 1}
    assert {bytes(r.bytes) for r in found.collect()} == twice and total == len(texts) == packed.count()
    share = sum(len(t) for t in twice) / sum(map(len, normal))
    print(f"suspects' share of the texts' bytes: {share:.3f}")
    assert share < 0.2 and {bytes(r.sha) for r in groups.collect()} == {hashlib.sha256(t).digest() for t in twice}
    plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(block") <= 1  # the answers alone
    blocks.close()


def test_groups_over_blocks(spark):
    rows = [(i, f"text {i % 300}" if i % 3 else "hot") for i in range(3000)] + [(None, "hot"), (None, "lone"), (None, " lone")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = [tuple(r)[:4] for r in exact_dedup.exact_classes(frame).collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault(exact_dedup.normal(t), []).append(i)
    want = []
    for ids in groups.values():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep) for i in ids]
    assert sorted(map(str, got)) == sorted(map(str, want)) and exact_dedup.exact_dedup(frame).count() == len(groups)


# Telephony: the decoders again, sample by sample.
def _alaw(code):
    code ^= 0x55
    size, step = (code & 15) << 4, code >> 4 & 7
    size = size + 8 if step == 0 else (size + 0x108) << step - 1
    return size if code & 0x80 else -size


def _mulaw(code):
    code = ~code & 0xFF
    size = ((code & 15) * 8 + 0x84 << (code >> 4 & 7)) - 0x84
    return -size if code & 0x80 else size


def _adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            change = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                change += part if code & bit else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(value)
    return out


def _resampled(x, rate, to):
    out = []
    for k in range(-(-len(x) * to // rate)):
        i, part = divmod(k * rate, to)
        j = min(i + 1, len(x) - 1)
        out.append((x[i] * (to - part) + x[j] * part) // to)
    return out


def test_audio_sample_by_sample():
    data = np.random.default_rng(4).integers(0, 256, 36 * 40, np.uint8)
    raw = data.tobytes()
    want = {telephony.ALAW: [_alaw(b) for b in raw], telephony.MULAW: [_mulaw(b) for b in raw], telephony.ADPCM: [s for i in range(0, len(raw), 36) for s in _adpcm(raw[i : i + 36])]}
    for kind, samples in want.items():
        media = telephony.wav(raw, kind, 8000, 36 if kind == telephony.ADPCM else 1)
        assert telephony.samples(media)[0].tolist() == samples
        for to in (8000, 16000, 6000, 11025, 44100):
            for step in (1 << 20, 100, 36):
                assert np.concatenate(list(telephony.pcm_parts(media, to, step))).tolist() == (_resampled(samples, 8000, to) if to != 8000 else samples)
    assert telephony.samples(telephony.wav(raw[:100], telephony.ADPCM, 8000, 36))[0].tolist() == want[telephony.ADPCM][: 2 * 65]
    x = want[telephony.MULAW]
    low = [v < 0 for v in x]
    feature = f"mulaw={sum(v * v for v in x)};alaw={sum(v * v for v in want[telephony.ALAW])};peak={max(map(abs, x))};crossings={sum(a != b for a, b in zip(low, low[1:]))};adpcm={sum(v * v for v in want[telephony.ADPCM])}"
    assert telephony._features([data], 36) == [feature] and telephony._features([data, data[:36]], 36)[0] == feature


def test_long_audio_is_stored_in_parts(spark):
    text = "long words of audio " * 180_000
    parts = telephony.store_audio(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string"))
    got = {r.doc_id: r for r in telephony.media_facts(parts).collect()}
    payload = text.encode() + b"\xff" * (-len(text) % 576)
    pcm = telephony.resample(telephony.MULAW_TABLE[np.frombuffer(payload, np.uint8)], 8000, 16000).astype(np.int64)
    assert parts.count() == 5 and got[1].pcm_energy == int((pcm * pcm).sum()) and got[1].payload_sha256 == hashlib.sha256(payload).hexdigest()
    assert got[1].feature == telephony._feature(np.frombuffer(payload, np.uint8), 36)


# Personal data.
_BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def _luhn(digits):
    double = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in double) % 10 == 0


def _base_spans(text):
    out = []
    for kind, regex in _BASE:
        for m in re.finditer(regex, text, re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and _luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            out += [f"{kind}:{m.start()}:{m.end()}"] if ok else []
    return out


def test_base_spans_of_a_table(spark, table):
    rows = [(r.doc_id, r.text) for r in table.collect()]
    rows += [(10_000, "1.2.3.4.5.6.7.8 é 4111-1111-1111-1111 0 +1 555 01099 9 a@b.c@d.e"), (10_001, "0" * 3000), (10_002, "9.9 " * 3000), (10_003, None), (None, "x@y.z")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        want = _base_spans(text or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), i
        assert set(want) <= set(got[i].spans.split(",")) | {""}
        assert [got[i][f"n_{k}"] for k, _ in _BASE] == [sum(s.startswith(k) for s in want) for k, _ in _BASE]


def test_context_finds_what_patterns_miss(spark, table):
    """Over a whole table with planted identifiers of other shapes: precision and recall of the spans added."""
    rows, truth, rng = [(r.doc_id, r.text or "") for r in table.collect()], set(), np.random.default_rng(8)
    lines = {"phone": ("call our office on {} today", "+1-555-010-{:04d}", "555.010.{:04d}x"), "email": ("please write to {} soon", "user{}@host{}.org", "user{} [at] host".replace(" ", "")), "ip": ("served from node {} again", "10.0.{}.7", "10-0-{}-7")}
    for n in range(360):
        kind = ("phone", "email", "ip")[n % 3]
        line, seen, unseen = lines[kind]
        k = int(rng.integers(0, 250))
        hidden = n % 45 < 3
        found = (unseen if hidden else seen).format(k, k)
        i, text = rows[n % len(rows)]
        begin = len(text) + 1 + line.index("{}")
        rows[n % len(rows)] = (i, f"{text}\n{line.format(found)}")
        if hidden:
            truth.add((i, f"{kind}:{begin}:{begin + len(found)}"))
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    added = {(r.doc_id, s) for r in got for s in r.spans.split(",") if s and s not in _base_spans(texts[r.doc_id])}
    recall, precision = len(added & truth) / len(truth), len(added & truth) / max(1, len(added))
    print(f"added {len(added)} spans, recall {recall:.2f}, precision {precision:.2f}")
    assert recall > 0.9 and precision > 0.8


def test_words_meet_spans_either_way(spark, monkeypatch):
    text = " ".join(f"host 10.0.0.{i % 256} user{i}@h.org n{i}" for i in range(400))
    frame = spark.createDataFrame([(1, text, 1)], "doc_id long, text string, rid long")
    found = pii.base_spans(frame, "rid")
    joined = {tuple(r) for r in pii._uses(found).collect()}
    monkeypatch.setattr(pii, "PAIRS", 1 << 40)
    assert joined == {tuple(r) for r in pii._uses(found).collect()} and sum(r[-1] is not None for r in joined) == 800


# Mixing.
def _mix_by_sorting(rows, weights=(1, 2, 3), most=3):
    """source to (target, {hash: repeats}) of rows (source, size, hash): shares by repeated capping, then rows by hash until the budget is met."""
    sizes = {}
    for s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total = {s: weights[i % len(weights)] for i, s in enumerate(order)}, sum(sizes.values())
    capped = set()
    while True:
        free = [s for s in order if s not in capped]
        level = Fraction(total - sum(most * sizes[s] for s in capped), max(1, sum(weight[s] for s in free)))
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            break
        capped |= over
    out = {}
    for s in order:
        target = Fraction(most * sizes[s]) if s in capped else weight[s] * level
        times = min(most, int(target // sizes[s])) if sizes[s] else 0
        need, by = target - times * sizes[s], {}
        for t, n, h in rows:
            if t == s and n:
                by[h] = by.get(h, 0) + n
        taken = {}
        for h in sorted(by):
            extra = by[h] <= need or (need * 2 > by[h])
            taken[h] = min(most, times + extra)
            if by[h] > need:
                need = Fraction(-1)
            else:
                need -= by[h]
        out[s] = (target, times, taken)
    return out


def test_mix_of_a_table(spark, table):
    docs = table.unionByName(table.where("doc_id % 40 = 3")).unionByName(spark.createDataFrame([(90_000, None, "en", "src1", 0), (90_001, "a b", "en", None, 3), (None, "c", None, "src2", 1)], table.schema))
    hashed = mixing._hashed(docs).select("doc_id", "source", "size", "hash")
    rows = [(r.source, r.size, r.hash) for r in hashed.collect()]
    want = _mix_by_sorting(rows)
    by_doc = {}
    for r in hashed.collect():
        target, times, taken = want[r.source]
        by_doc[r.doc_id, r.source] = (r.size, float(target), r.size * taken.get(r.hash, times))
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows) and all(by_doc[r.doc_id, r.source][0] == r.size and abs(by_doc[r.doc_id, r.source][1] - r.target) < 1e-6 and by_doc[r.doc_id, r.source][2] == r.taken for r in got)
    for s, (target, _, _) in want.items():
        mine = [r for r in got if r.source == s]
        border = {}
        for t, n, h in rows:
            if t == s:
                border[h] = border.get(h, 0) + n
        assert abs(sum(r.taken for r in mine) - target) <= max(border.values()) / 2 + 1


# URLs.
REFERENCES = ["b.html", "../d.html", "?p=1", "/e", "//h.org/f", "./", "..", "../../../g", "http://k.com/a/b?d#e", "a/./b/", "HTTP://K.com", "?u=http://z.org/", " s.html ", "a?b&amp;c", "../../x/../y"]


def _name(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)", url)
    return m[1].lower() + (m[2] or "/") + m[3]


def test_links_resolve_like_the_standard_library(spark):
    bases = ["http://x.net/a/c.html", "https://X.net", "http://x.net/a/b/?q=1", "http://x.net/a/b/c/d"]
    frame = spark.createDataFrame([(b, r) for b in bases for r in REFERENCES], "base string, to string")
    for r in frame.select("base", "to", url_filter.url_node(url_filter.url_resolved(F.col("base"), F.col("to"))).alias("node")).collect():
        assert r.node == _name(urljoin(r.base, r.to.strip().replace("&amp;", "&").split("#")[0])), (r.base, r.to)
    none = spark.createDataFrame([("http://x.net/", "#a"), ("http://x.net/", ""), ("http://x.net/", "mailto:a@b"), ("no", "a"), (None, "a"), ("http://x.net/", None)], "base string, to string")
    assert all(r.n is None for r in none.select(url_filter.url_resolved(F.col("base"), F.col("to")).alias("n")).collect())


def _random_pages(n, seed):
    rng = np.random.default_rng(seed)
    hosts, folders = ["a.net", "b.com", "c.org", "example.org", "d.net"], ["/es/", "/en/", "/de/", "/fr/", "/x/y/"]
    out = []
    for i in range(n):
        url = f"http://{rng.choice(hosts)}{rng.choice(folders)}p{i % 60}"
        k = int(rng.integers(0, 60))
        to = str(rng.choice([f"p{k}", f"../de/p{k}", "?q", f"//b.com/de/p{k}", "/fr/p3", f"http://d.net/x/y/p{k}", "#top"]))
        html = ["", None, f'<p><link rel="canonical" href="{to}">', f"<LINK href='{to}' rel='canonical'>", f'<meta http-equiv="refresh" content="0; url={to}">'][int(rng.integers(5))]
        out.append((i, None if i % 97 == 7 else url, html, "x"))
    return out + out[:5]


def test_verdicts_equal_a_search(spark):
    import duckdb
    import pandas as pd

    rows = _random_pages(300, 3)
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in url_filter.url_verdicts(frame).collect())

    def rule(host, path):
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else ("", None)

    links = {}
    for _, url, html, _ in rows:
        m = re.search(r"""(?:href|url)=["']?([^"'>]*)""", html or "")
        if url and m and m[1] and not m[1].startswith("#"):
            a, b = _name(url), _name(urljoin(url, m[1]))
            links.setdefault(a, set()).add(b)
            links.setdefault(b, set()).add(a)
    blocked, todo = set(), [n for n in links if rule(n.split("/")[0], n[len(n.split("/")[0]) :].split("?")[0])[1] == "block"]
    while todo:
        n = todo.pop()
        if n not in blocked:
            blocked.add(n)
            todo += links[n]
    want = []
    for i, url, _, _ in rows:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        name, verdict = rule(host, path)
        want.append((i, host, path, name, verdict or ("block" if m and _name(url) in blocked else "allow")))
    assert got == sorted(want) and sum(x[3] == "" and x[4] == "block" for x in got) > 20
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html", "_"]))
    assert sorted((a, b, c, d or "", e) for a, b, c, d, e in con.execute(url_filter.OP7_SQL).fetchall()) == got


def test_many_records_and_archives(spark):
    rows = [(i, f"u{i}", f"page {i % 700}" if i % 3 else "hot", "x") for i in range(4000)] + [(9000 + i, "u", chr(97 + i) * (5 << 20), "x") for i in range(4)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    archives = warc.write_archives(frame)
    got = {r.page_id: r for r in warc.read_archives(archives).drop("payload").collect()}
    largest = {}
    for i, _, html, _ in rows:
        largest[html] = max(i, largest.get(html, -1))
    assert len(got) == len(rows) and all((got[i].record_type, got[i].refers_to) == (("response", None) if largest[h] == i else ("revisit", largest[h])) for i, _, h, _ in rows)
    assert archives.count() > 3

    def seconds(n):
        content = warc.write_record("response", 1, "u", "A" * 32, b"x", None, "d") * n
        began = datetime.datetime.now()
        assert sum(1 for _ in warc.read_records(content)) == n
        return (datetime.datetime.now() - began).total_seconds()

    seconds(100)
    assert seconds(32_000) < 16 * max(seconds(4000), 0.02)
    with pytest.raises(ValueError):
        list(warc.read_records(warc.write_record("response", 1, "u", "A" * 32, b"x", None, "d")[:-9]))


# Toxicity and language.
def _score(model, text):
    """A text's score by a plain forward-backward pass."""
    import pyarrow as pa

    data, _, start, end, _ = toxicity.tokens(pa.array([text]))
    weights = dict(zip(model.keys.tolist(), model.weights.tolist()))
    scores = [model.bias + sum(weights.get(f, 0.0) for f in row) for row in toxicity.feature_hashes(data, start, end).tolist()]
    a, left = (1.0, 0.0), []
    for s in scores:
        x = [(a[0] * model.moves[0][k] + a[1] * model.moves[1][k]) * (np.exp(np.clip(s, -30, 30)) if k else 1.0) for k in (0, 1)]
        a = (x[0] / sum(x), x[1] / sum(x))
        left.append(a)
    b, p = (1.0, 1.0), []
    for s, f in zip(scores[::-1], left[::-1]):
        p.append(f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]))
        y = (b[0], b[1] * np.exp(np.clip(s, -30, 30)))
        b = tuple(model.moves[k][0] * y[0] + model.moves[k][1] * y[1] for k in (0, 1))
        b = (b[0] / sum(b), b[1] / sum(b))
    total = sum(x for x in p if x > toxicity.FLOOR)
    z = np.dot(model.link, [1, np.log1p(total), max(p, default=0), min(1, 10 * total / max(1, len(p)))])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@pytest.fixture(scope="module")
def tagger(spark, table):
    return toxicity.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))


def test_scores_of_a_table(spark, table, tagger):
    long = " ".join(f"w{i % 50}" for i in range(200_000))
    rows = [(r.doc_id, r.text, "x") for r in table.limit(60).collect()] + [(None, "a b", "x"), (7000, long, "x"), (7001, None, "x"), (7001, None, "x")]
    got = toxicity.tag(spark.createDataFrame(rows, "doc_id long, text string, score string"), tagger).collect()
    scores = {r.doc_id: r.score for r in got}
    assert len(got) == len(rows) and all(abs(scores[i] - _score(tagger, t or "")) < 1e-6 for i, t, _ in rows)


def test_held_out_toxic_documents(spark, tagger):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    got = {r.doc_id: r.score for r in toxicity.tag(docs, tagger).collect()}
    held = [(got[r.doc_id], r.toxic) for r in labels.collect() if r.doc_id in got and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    good, bad = [s for s, t in held if not t], [s for s, t in held if t]
    assert np.mean([[b > g for g in good] for b in bad]) > 0.85 and np.mean([s >= 0.3 for s in good]) < 0.05


def test_long_toxic_texts_are_learned(spark):
    rng = np.random.default_rng(2)
    words = np.array([f"v{i}" for i in range(400)])
    rows, labels = [], []
    for i in range(160):
        text = rng.choice(words, 5000)
        if i % 2:
            text[rng.integers(0, 5000, 400)] = rng.choice(["nasty", "awful"], 400)
        rows.append((i, " ".join(text)))
        labels.append((i, i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([*labels, (999, 1)], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.tag(docs, model).collect()}
    assert np.mean([(got[i] > 0.5) == bool(t) for i, t in labels]) > 0.95


def test_gradients_are_slopes():
    rng = np.random.default_rng(0)
    net = language_id.first_net(3, np.random.Generator(np.random.PCG64(1)), np.float64)
    steps = rng.integers(97, 105, (9, 4))
    steps[6:, 1] = language_id.PAD
    weight, labels = (steps != language_id.PAD).astype(float), np.array([0, 1, 2, 1])
    loss, grads = language_id.gradients(net, steps, weight, labels)
    for k, g in enumerate(grads):
        for _ in range(6):
            at = tuple(int(rng.integers(0, n)) for n in g.shape)
            if k in (0, 1, 2, 6, 7, 8):
                at = (int(rng.integers(97, 105)), at[1])
            old, slopes = net[k][at], []
            for d in (1e-5, -1e-5):
                net[k][at] = old + d
                slopes.append(language_id.gradients(net, steps, weight, labels)[0])
            net[k][at] = old
            assert abs((slopes[0] - slopes[1]) / 2e-5 - g[at]) < 1e-6


def test_chunks_read_like_whole_texts(monkeypatch):
    net = language_id.first_net(3, np.random.Generator(np.random.PCG64(2)))
    model = language_id.Model(["a", "b", "c"], net)
    texts = [b"", b"ab", b"some words of a text " * 40, b"12 34", b"x" * 500]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    sums, n = language_id.pooled(model, data, at)
    monkeypatch.setattr(language_id, "CHUNK", 1000)
    whole, m = language_id.pooled(model, data, at)
    assert n.tolist() == m.tolist() == [0, 2, 640, 0, 500] and np.allclose(sums, whole, atol=0.5)


def test_languages_of_odd_rows(spark):
    names = language_id.Model(["a", "b"], [np.zeros_like(p) for p in language_id.first_net(2, np.random.Generator(np.random.PCG64(1)))])
    rows = [(1, "tie", "x"), (1, "tie", "x"), (None, "é", "x"), (2, None, "x"), (3, "12", "x"), (4, "word " * 100_000, "x")]
    got = language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string"), names).collect()
    assert sorted(map(str, [(r.doc_id, r.lang_pred, round(r.score, 3)) for r in got])) == sorted(map(str, [(1, "a", 0.5), (1, "a", 0.5), (None, "a", 0.5), (2, "und", 0.0), (3, "und", 0.0), (4, "a", 0.5)]))


# The pipeline.
def test_pipeline_by_hand(spark, table, tagger):
    import corpus_pipeline
    import tiktoken

    stage = dict(corpus_pipeline.STAGES)
    docs = table.unionByName(table.where("doc_id % 50 = 1")).unionByName(spark.createDataFrame([(80_000, None, None, None, 0), (80_001, "", "en", "src1", 0), (80_002, " ", "en", "src1", 1)], table.schema))
    model = toxicity.train(table, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    rows = [tuple(r) for r in docs.collect()]
    kept = [r for r in rows if _score(model, r[1] or "") < toxicity.THRESHOLD]
    got = stage["toxicity"](spark, docs, FOLDER)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, kept)) and got.columns == docs.columns
    least = {}
    for r in kept:
        key = exact_dedup.normal(r[1])
        least[key] = min(least.get(key, r), r, key=lambda x: (x[0] is None, x[0]))
    got = stage["exact dedup"](spark, spark.createDataFrame(kept, docs.schema), FOLDER)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, least.values()))
    classes = _classes([(r[0], r[1]) for r in least.values()], 80)
    left = [r for r in least.values() if classes[r[0]][1] == r[0]]
    got = stage["near dedup"](spark, spark.createDataFrame(list(least.values()), docs.schema), FOLDER)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, left))
    frame = spark.createDataFrame(left, docs.schema)
    hashed = [(r.doc_id, r.source, r.size, r.hash) for r in mixing._hashed(frame).collect()]
    plan = _mix_by_sorting([(s, n, h) for _, s, n, h in hashed])
    times = {i: plan[s][2].get(h, plan[s][1]) for i, s, _, h in hashed}
    mixed = [r for r in left for _ in range(times[r[0]])]
    got = stage["mixing"](spark, frame, FOLDER)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, mixed))
    path, pattern = byte_bpe.vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    want = [(r[0], len(ids := library.encode_ordinary(r[1] or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in mixed]
    got = stage["byte-level BPE"](spark, spark.createDataFrame(mixed, docs.schema), FOLDER)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_stages_on_an_empty_table(spark, table):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table.limit(0), FOLDER).count() == 0


def test_blocks_outlive_their_name(spark):
    blocks = Blocks(spark.range(10).select((F.col("id") % 3).alias("block"), "id"), "rows")
    assert blocks.grouped("id").count().count() == 3
    blocks.close()
    assert blocks.rows.count() == 10
