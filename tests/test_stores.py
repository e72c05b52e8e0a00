import hashlib
import os

import pytest
from pyspark.sql import functions as F

from treeline.functions import digest, unicode
from treeline.operators import checks
from treeline.sources import folder, store

HEADER = "version_id string, protocol string, root_id string, parents array<string>, created_at string"
BINDING = "version_id string, path string, kind string, object_id string, object_version_id string, content_sha256 string, bytes long, executable boolean, target string"
DEAD = "version_id string, path string, object_id string, deleted_kind string, last_object_version_id string"
OUT = "version_id string, path string, kind string, reason string"
SHA = hashlib.sha256(b"x").hexdigest()


def _version(spark, bindings, tombstones=(), exclusions=(), headers=(("v1", "0.4", "r1", ["v0"], "2026-01-01T00:00:00Z"),)):
    made = ((headers, HEADER), (bindings, BINDING), (tombstones, DEAD), (exclusions, OUT))
    return dict(zip(("headers", "bindings", "tombstones", "exclusions"), (spark.createDataFrame(list(r), s) for r, s in made), strict=True))


def _framed(text):
    return len(text.encode()).to_bytes(4, "big") + text.encode()


def test_version_digest_matches_plain_bytes(spark):
    bindings = [("v1", "z/é.md", "regular_file", "o1", "w1", SHA, 300, True, None), ("v1", "a", "directory", "o2", None, None, None, None, None), ("v1", "l", "symlink", "o3", "w3", None, None, None, "a")]
    got = digest.version_digests(**_version(spark, bindings, [("v1", "gone", "o9", "regular_file", "w9"), ("v1", "dir", "o8", "directory", None)], [("v1", "n", "nested_root", "nested-boundary")])).collect()
    want = b"treeline-version-v1\0" + _framed("0.4") + _framed("r1") + _framed("v1") + b"\1" + _framed("v0") + _framed("2026-01-01T00:00:00Z")
    want += (3).to_bytes(4, "big") + _framed("a") + _framed("o2") + _framed("live") + b"\0"
    want += _framed("l") + _framed("o3") + _framed("live") + b"\2" + _framed("w3") + _framed("a") + _framed("relative")
    want += _framed("z/é.md") + _framed("o1") + _framed("live") + b"\1" + _framed("w1") + bytes.fromhex(SHA) + (300).to_bytes(8, "big") + b"\1"
    want += (2).to_bytes(4, "big") + _framed("dir") + _framed("o8") + _framed("deleted") + b"\0\0" + _framed("gone") + _framed("o9") + _framed("deleted") + b"\1\1" + _framed("w9")
    want += (1).to_bytes(4, "big") + _framed("n") + b"\0" + _framed("nested-boundary")
    assert [tuple(r) for r in got] == [("v1", hashlib.sha256(want).hexdigest())]


def test_version_digest_of_empty_unknown_and_large_versions(spark):
    assert digest.version_digests(**_version(spark, [])).first()["version_sha256"] is not None
    assert digest.version_digests(**_version(spark, [("v1", "a", "strange", "o", None, None, None, None, None)])).first()["version_sha256"] is None
    parts = _version(spark, [])
    many = spark.range(16_385).select(F.lit("v1").alias("version_id"), F.col("id").cast("string").alias("path"), F.lit("directory").alias("kind"), F.lit("o").alias("object_id"), *(F.lit(None).cast(t).alias(n) for n, t in (("object_version_id", "string"), ("content_sha256", "string"), ("bytes", "long"), ("executable", "boolean"), ("target", "string"))))
    assert digest.version_digests(**(parts | {"bindings": many})).first()["version_sha256"] is None
    assert digest.version_digests(**_version(spark, [], headers=[])).count() == 0


def test_folding_and_collisions(spark):
    rows = spark.createDataFrame([("Straße",), ("STRASSE",), ("Café",), ("café",), ("Plain",), ("plain",), ("alone",), (None,)], "path string")
    got = {(r["key"], r["n"]) for r in checks.collisions(rows).collect()}
    assert got == {("strasse", 2), ("café", 2), ("plain", 2)}
    assert [r[0] for r in rows.where("path like 'Caf%'").select(unicode.composed(F.col("path"))).collect()] == ["Café"]


@pytest.mark.parametrize("splits", [1, 3, 64])
def test_folder_scan(spark, tmp_path, splits):
    for name in ("a/b/one.txt", "a/two.tmp", "build/x/y.txt", "nest/.treeline/s", "nest/inner.txt", "top.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("12345")
    (tmp_path / "link").symlink_to("top.md")
    (tmp_path / "hard1").write_text("h")
    os.link(tmp_path / "hard1", tmp_path / "hard2")
    os.mkfifo(tmp_path / "pipe")
    (tmp_path / "top.md").chmod(0o700)
    (tmp_path / "a/b/one.txt").chmod(0)
    spark.dataSource.register(folder.FolderSource)
    got = spark.read.format(folder.FORMAT).option("splits", splits).option("rules", "*.tmp\nbuild/\n!build/x/").load(str(tmp_path))
    rows = {r["path"]: tuple(r)[1:] for r in got.collect()}
    assert len(rows) == got.count()
    none = (None,) * 3
    assert rows == {
        "a": ("directory", *none, None), "a/b": ("directory", *none, None), "a/b/one.txt": ("regular_file", 5, False, None, None),
        "a/two.tmp": (None, *none, "capture-ignore-policy"), "build": (None, *none, "capture-ignore-policy"),
        "nest": ("nested_root", *none, "nested-boundary"), "top.md": ("regular_file", 5, True, None, None),
        "link": ("symlink", None, None, "top.md", None), "pipe": ("fifo", *none, "unsupported"),
        "hard1": ("hard_link", *none, "unsupported"), "hard2": ("hard_link", *none, "unsupported"),
    }


def test_folder_scan_of_empty_root(spark, tmp_path):
    assert folder.scan(spark, str(tmp_path)).count() == 0


def test_blobs_are_stored_once(spark, tmp_path):
    at = str(tmp_path / "blobs")
    objects = spark.createDataFrame([(b"x",), (b"x",), (b"",), (None,)], "content binary")
    store.install_blobs(objects, at)
    store.install_blobs(objects.unionByName(spark.createDataFrame([(b"new",)], "content binary")), at)
    assert sorted(r["content"] for r in spark.read.parquet(at).collect()) == [b"", b"new", b"x"]


def test_versions_and_head(spark, tmp_path):
    at, heads = str(tmp_path / "versions"), str(tmp_path / "heads")
    parts = _version(spark, [("v1", "a", "directory", "o2", None, None, None, None, None)])
    stored = store.install_version(parts, at, "v1")
    assert digest.version_digests(**store.read_version(spark, at, "v1")).first()["version_sha256"] == stored
    with pytest.raises(Exception, match="(?i)exist"):
        store.install_version(parts, at, "v1")
    assert store.head(spark, heads) == (0, None)
    assert store.swap_head(spark, heads, None, "v1") == 1
    assert store.swap_head(spark, heads, "v1", "v2") == 2
    with pytest.raises(store.Conflict):
        store.swap_head(spark, heads, "v1", "v3")
    assert store.head(spark, heads) == (2, "v2")
