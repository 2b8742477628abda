import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairfold.operators import catalogue as cat
from pairfold.plans.picture_files import jpeg_bytes, png_bytes
from pairfold.sources import image_files, images

ROWS = [
    ("animate/animal/dog01.png", 3, ["animate", "animal", "dog"], 1),
    ("animate/animal/dog 02.png", 4, ["animate", "animal", "dog_"], 2),
    ("animate/animal/big cat03.png", 3, ["animate", "animal", "big_cat"], 3),
    ("inanimate/natural/a1b2.png", 3, ["inanimate", "natural", "ab"], 12),
    (" animate /animal/dog04.png", 3, ["animate", "animal", "dog"], 4),
    ("Brand 7/x1.png", 3, ["Brand 7", "x"], 1),
    ("root1.png", 3, ["root"], 1),
    ("a/b/c/d/e9.png", 3, ["a", "b", "c", "d", "e"], 9),
]
BAD = [("animate/animal/dog.png", 3, "name does not end with a digit"), ("animate/animal/dog05.png", 1, "not three-dimensional"), ("animate/animal/dog06.png", None, "not readable"), (None, 3, "outside the base folder")]
SCHEMA = "path string, height int, width int, n_channels int"


def test_paths_and_rejects(spark):
    df = spark.createDataFrame([(p, 5, 7, c) for p, c, *_ in ROWS + BAD], SCHEMA)
    got = {r["path"]: r for r in images.catalogue(df).collect()}
    assert {p: (r["cats"], r["instance"], r["has_alpha"], r["extension"]) for p, r in got.items()} == {p: (c, i, n == 4, ".png") for p, n, c, i in ROWS}
    assert {r["path"]: r["reason"] for r in images.rejects(df).collect()} == {p: why for p, _, why in BAD}


def test_empty_catalogue_keeps_its_schema(spark):
    df = images.catalogue(spark.createDataFrame([], SCHEMA))
    assert df.columns == images.CATALOGUE and df.count() == 0


def _png(path, width, height, kind, data_ok=True):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(png_bytes(width, height, kind) if data_ok else b"no image")


def test_folder(spark, tmp_path):
    _png(tmp_path / "animate/animal/dog 01.png", 30, 20, 2)
    _png(tmp_path / "animate/animal/cat02.png", 8, 9, 6)
    _png(tmp_path / "grey3.png", 8, 9, 0)
    _png(tmp_path / "_new/deep/_more/owl05.png", 8, 9, 2)
    _png(tmp_path / "bad4.png", 8, 9, 2, data_ok=False)
    rows = {r["path"]: r for r in images.as_frame(spark, str(tmp_path), ["png"]).collect()}
    assert set(rows) == {"animate/animal/dog 01.png", "animate/animal/cat02.png", "_new/deep/_more/owl05.png"}
    assert {tuple(r["node"]): r["n"] for r in cat.as_tree(str(tmp_path), spark).collect()}[()] == 3
    r = rows["animate/animal/dog 01.png"]
    assert (r["cat1"], r["cat3"], r["height"], r["width"], r["n_channels"], r["has_alpha"]) == ("animate", "dog_", 20, 30, 3, False)
    why = {r["path"]: r["reason"] for r in images.rejects(images.scan(spark, str(tmp_path))).collect()}
    assert why == {"grey3.png": "not three-dimensional", "bad4.png": "not readable"}
    with pytest.raises(ValueError):
        images.scan(spark, str(tmp_path / "none"))


def _probe(data, whole=False):
    file = image_files.Ranges(pa.BufferReader(data))
    try:
        return image_files.probe(file, whole), file.read
    except image_files.Broken as e:
        return str(e), file.read


def test_png_structure():
    good = png_bytes(30, 20)
    assert _probe(good)[0] == (20, 30, 3) and _probe(good, True)[0] == (20, 30, 3)
    assert [_probe(png_bytes(3, 2, c))[0][2] for c in (0, 2, 3, 4, 6)] == [1, 3, 3, 4, 4]
    assert _probe(png_bytes(3, 2, 3, transparent=True))[0][2] == 4
    for n in range(len(good)):  # cut off anywhere
        assert isinstance(_probe(good[:n])[0], str), n
    for at in range(len(good)):  # any byte damaged: each is under a checksum, or a length, type or signature
        assert isinstance(_probe(good[:at] + bytes([good[at] ^ 0x55]) + good[at + 1 :])[0], str), at
    no_data = good[: good.index(b"IDAT") - 4] + good[good.index(b"IEND") - 4 :]
    assert _probe(no_data)[0] == "there is no pixel data"


def test_png_pixels_only_when_asked():
    rows = (b"\0" + bytes(90)) * 20
    short, filtered, more = png_bytes(30, 20, pixels=rows[:-1]), png_bytes(30, 20, pixels=b"\5" + rows[1:]), png_bytes(30, 20, pixels=rows + b"\0")
    for bad in (short, filtered, more):
        assert _probe(bad)[0] == (20, 30, 3) and isinstance(_probe(bad, True)[0], str)
    # rows of the passes of an interlaced image of 5 x 3: 1x1, 1x1, none, 1x1 (third row holds none), ...
    passes = [(1, 1), (1, 1), (0, 0), (1, 1), (3, 1), (2, 2), (5, 1)]
    laced = b"".join((b"\0" + bytes(3 * w)) * h for w, h in passes)
    assert _probe(png_bytes(5, 3, laced=1, pixels=laced), True)[0] == (3, 5, 3)


def test_big_png_is_walked_not_read():
    noise = os.urandom(4_000_000)
    data = png_bytes(1000, 1333, pixels=noise)
    assert len(data) > 3_900_000 and _probe(data)[0] == (1333, 1000, 3) and _probe(data)[1] < len(data) / 100


def test_jpeg_structure():
    good = jpeg_bytes(30, 20)
    assert _probe(good)[0] == (20, 30, 3) and _probe(jpeg_bytes(3, 2, 1))[0] == (2, 3, 1) and _probe(jpeg_bytes(3, 2, 4))[0][2] == 4
    for n in range(len(good)):
        assert isinstance(_probe(good[:n])[0], str), n
    assert _probe(good[:2] + b"\xff\xff\xfe\0\4hi" + good[2:] + b"more", True)[0] == (20, 30, 3)  # padding, a comment, what follows
    assert isinstance(_probe(good[:2] + good[-2:])[0], str) and isinstance(_probe(b"")[0], str)


def test_scan_reads_every_file_of_every_folder(spark, tmp_path):
    """Names that begin with "_" or ".", other cases of extensions, more folders than the driver lists, files without image."""
    for k in range(30):
        _png(tmp_path / f"a{k % 6}/_b{k % 5}/.c/x{k}.png", 2, k + 1, 2)
    for name in ("_x1.png", ".x2.png", "x3.PNG", "x4.jpg.txt"):
        _png(tmp_path / name, 2, 2, 2)
    (tmp_path / "e5.png").write_bytes(b"")
    (tmp_path / "empty").mkdir()
    (tmp_path / "photo6.jpg").write_bytes(jpeg_bytes(7, 8))
    (tmp_path / "really a jpeg7.png").write_bytes(jpeg_bytes(7, 8))
    found = {r["path"]: r["height"] for r in images.scan(spark, str(tmp_path), ["png", "jpg"]).collect()}
    assert found == {f"a{k % 6}/_b{k % 5}/.c/x{k}.png": k + 1 for k in range(30)} | {"_x1.png": 2, ".x2.png": 2, "e5.png": None, "photo6.jpg": 8, "really a jpeg7.png": 8}
    few = images.files_of(spark, f"file:{tmp_path}", ["png"])
    reader = image_files.ImageReader({"path": str(tmp_path), "folders": "3", "filesPerPartition": "2"})
    parts = reader.partitions()
    assert any(p.folders for p in parts) and max(len(p.files) for p in parts) == 2
    assert sorted(p for part in parts for b in reader.read(part) for p in b["path"].to_pylist()) == sorted(r["path"] for r in few.collect())
    assert images.scan(spark, str(tmp_path / "empty")).count() == 0


def test_driver_holds_few_names(spark, tmp_path):
    """Folders with more files or subfolders than the driver may hold are listed by tasks, and their files are dealt to several."""
    for k in range(40):
        _png(tmp_path / f"big/x{k}.png", 2, k + 1, 2)
        _png(tmp_path / f"big/deep{k % 2}/{k}/y{k}.png", 2, 1, 2)
        _png(tmp_path / f"many/{k}/z{k}.png", 2, 1, 2)
    _png(tmp_path / "r1.png", 2, 2, 2)
    (tmp_path / "big/broken link9.png").symlink_to(tmp_path / "nothing")
    want = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.png") if p.is_file())
    for names in (0, 1, 10, 45, 100, 50000):
        reader = image_files.ImageReader({"path": str(tmp_path), "names": str(names), "folders": "100"})
        parts = reader.partitions()
        assert sum(len(p.files) + len(p.folders) + len(p.flat) for p in parts) <= names + 4, names
        assert sorted(p for part in parts for b in reader.read(part) for p in b["path"].to_pylist()) == want, names
    found = images.scan(spark, str(tmp_path / "big"))
    assert found.groupBy(F.spark_partition_id()).count().count() > 1 and found.count() == 80


def test_pictures_are_scanned_once(spark):
    from pairfold.plans import queries

    plan = queries.scanned_images(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("image_files") == 1 and "Join" not in plan


def test_whole_check_in_a_scan(spark, tmp_path):
    (tmp_path / "a1.png").write_bytes(png_bytes(30, 20, pixels=b"\0" * 5))
    assert images.scan(spark, str(tmp_path)).first()["height"] == 20
    assert images.scan(spark, str(tmp_path), check="whole").first()["height"] is None


def test_readers_of_stores_that_arrow_has_not(spark, tmp_path, monkeypatch):
    _png(tmp_path / "animate/dog 01.png", 30, 20, 2)
    _png(tmp_path / "bad4.png", 8, 9, 2, data_ok=False)

    def none(uri):
        raise pa.ArrowInvalid(uri)

    monkeypatch.setattr(images, "file_system", none)
    assert {r["path"]: r["height"] for r in images.scan(spark, str(tmp_path), ["png", "jpg"]).collect()} == {"animate/dog 01.png": 20, "bad4.png": None}


COUNTS = [(["a", "b", "c"], 2), (["a", "b", "d"], 3), (["a", "b"], 4), (["e"], 5)]


def test_tree(spark):
    counts = spark.createDataFrame(COUNTS, "cats array<string>, n long")
    nodes = {tuple(r["node"]): r["n"] for r in cat.tree_nodes(counts).collect()}
    assert nodes == {("a", "b", "c"): 2, ("a", "b", "d"): 3, ("a", "b"): 9, ("a",): 9, (): 9}
    edges = {(tuple(r["parent"]), tuple(r["child"])) for r in cat.tree_edges(counts).collect()}
    assert edges == {((), ("a",)), (("a",), ("a", "b")), (("a", "b"), ("a", "b", "c")), (("a", "b"), ("a", "b", "d"))}
    text = cat.newick(counts)
    assert text.first()[0] == "((('c-2','d-3')'b-9')'a-9')'ROOT-9';"
    back = {(r["name"], r["parent"]) for r in cat.parse_newick(text).collect()}
    assert {n for n, _ in back} == {"c-2", "d-3", "b-9", "a-9", "ROOT-9"}
    assert {tuple(r["node"]): r["n"] for r in cat.tree_nodes(counts, False).collect()} == {tuple(c): n for c, n in COUNTS[:3]}


def test_newick_with_apostrophes(spark):
    text = cat.newick(spark.createDataFrame([(["o'a", "b,(c"], 2), (["o'a", ""], 1)], "cats array<string>, n long"))
    assert text.first()[0] == "('-1','b,(c-2')'o''a-3')'ROOT-3';".replace("(", "((", 1)
    rows = cat.parse_newick(text).collect()
    names = {r["node"]: r["name"] for r in rows}
    assert {(r["name"], names.get(r["parent"])) for r in rows} == {("-1", "o'a-3"), ("b,(c-2", "o'a-3"), ("o'a-3", "ROOT-3"), ("ROOT-3", None)}
    plain = cat.parse_newick(spark.createDataFrame([("((a,b),c)r;",), ("",), (None,)], "newick string"))
    assert sorted((r["name"], r["parent"]) for r in plain.collect()) == [("", 4), ("a", 2), ("b", 2), ("c", 4), ("r", None)]


def test_newick_of_nothing(spark):
    assert cat.newick(spark.createDataFrame([], "cats array<string>, n long")).first()[0] == "'ROOT-0';"


def test_counts_of_gaps(spark):
    rows = [("a", None, "b", 2), ("a", "b", None, 1), ("a", None, "b", 3), (None, None, None, 4)]
    df = spark.createDataFrame(rows, "cat1 string, cat2 string, cat10 string, o int")
    assert [tuple(r) for r in cat.as_counts(df).collect()] == [(["a", "b"], 3)]
    assert [tuple(r) for r in cat.as_counts(df, order="o").collect()] == [(["a", "b"], 1)]


def test_histogram_counts_every_category(spark):
    counts = spark.createDataFrame([(["animate", "animal", "x"], 2), (["animate", "human", "y"], 2), (["z"], 5)], "cats array<string>, n long")
    got = {(r["panel"], r["size"]): r["categories"] for r in cat.size_histogram(counts).collect()}
    assert got == {("All Categories", 2): 2, ("All Categories", 5): 1, ("Animate", 2): 2, ("Animate/Animal", 2): 1, ("Animate/Human", 2): 1}
    assert cat.largest_size(counts).first()[0] == 6
