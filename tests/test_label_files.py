"""Label files of many images: the folders of Spark's text sink, a whole file an image, written without a process a file."""

from pathlib import Path

from fringeframe.sources import labels


def told(spark, path):
    """Folder to its sorted lines, and the names of all files."""
    files = [f for f in Path(path).rglob("*") if f.is_file() and not f.name.startswith((".", "_"))]
    found = {}
    for f in files:
        found.setdefault(str(f.parent.relative_to(path)), []).extend(f.read_bytes().decode().split("\n")[:-1])
    return {k: sorted(v) for k, v in found.items()}, {f.name for f in Path(path).rglob("*") if f.is_file()}


def test_folders_and_lines_are_those_of_the_text_sink(spark, tmp_path):
    odd = ["a b", "x/y", "50%=é", "#[q]^{r}", 'd"e\'f:*?\\', None, ""]
    rows = [("val" if i % 4 == 0 else "train", name, f"0 0.{i} {k}") for i, name in enumerate(odd) for k in range(3)]
    # An image of more lines than a batch, and lines without text.
    rows += [("train", "long", f"0 {k}") for k in range(25_000)] + [(None, "empty", None), ("val", "empty", "")]
    df = spark.createDataFrame(rows, "split string, image string, line string").repartition(5)
    theirs, ours = tmp_path / "sink", tmp_path / "with a space" / "ours"
    df.repartition("split", "image").write.partitionBy("split", "image").text(str(theirs))
    labels.write_box_labels(df, str(ours), ["split", "image"])
    assert told(spark, ours)[0] == told(spark, theirs)[0]
    assert told(spark, ours)[1] == {"labels.txt", "_SUCCESS"}
    assert spark.read.text(str(ours)).count() == len(rows)


def test_labels_replace_what_was_there(spark, tmp_path):
    df = spark.createDataFrame([(i, f"0 {i}") for i in range(6)], "field_id bigint, line string")
    for kept in (df, df.filter("field_id < 2"), df.filter("field_id < 0")):
        labels.write_box_labels(kept, f"file:{tmp_path}/l", ["field_id"])
        assert told(spark, tmp_path / "l")[0] == {f"field_id={r['field_id']}": [r["line"]] for r in kept.collect()}


def test_a_task_run_again_replaces_its_files(tmp_path):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"field_id": ["1", "1", "2"], "line": ["a", "b", "c"]})
    for _ in range(2):
        labels.LabelWriter({"path": f"file:{tmp_path}"}).write(iter([batch]))
    assert told(None, tmp_path)[0] == {"field_id=1": ["a", "b"], "field_id=2": ["c"]}


def test_centers_of_written_files_keep_their_image(spark, tmp_path):
    rows = [(i, f"0 0.5 0.25 0.1 0.1 {i}.5 {i}.25 2") for i in range(2, 40)] + [(7, "0 0.5 0.25 0.1 0.1"), (7, "")]
    df = spark.createDataFrame(rows, "field_id bigint, line string")
    labels.write_box_labels(df, str(tmp_path / "l"), ["field_id"])
    found = {r["path"]: (r["x"], r["y"]) for r in labels.read_centers(spark, str(tmp_path / "l"), 100, 80).filter("x <> 50").collect()}
    assert {p.rsplit("/l/", 1)[1]: v for p, v in found.items()} == {f"field_id={i}/labels.txt": (i + 0.5, i + 0.25) for i in range(2, 40)}


def test_lines_and_paths_are_those_of_the_text_source(spark, tmp_path):
    import gzip

    body = "﻿0 0.5 0.25 0.1 0.1\r\n0 1 1 0 0\r0 2 2 0 0\n\n  \n0 é 3 0 0".encode()
    for name in ("a b", "x%y", "é=#", "k=1;[z]{}^`|\"<>", "nb sp ", "_k=1", "_hidden", ".dot", "_metadata_kept", "c._COPYING_"):
        folder = tmp_path / "in it" / name
        folder.mkdir(parents=True)
        (folder / "labels.txt").write_bytes(body)
        (folder / "z.txt.gz").write_bytes(gzip.compress(b"0 8 8 8 8\n") + gzip.compress(b"0 9 9 9 9"))
        (folder / "_s.txt").write_bytes(b"0 7 7 7 7")
        (folder / "empty.txt").write_bytes(b"")
    # Longer than the blocks of a file, cut in lines and in \r\n; a line longer than a block; bytes that are no UTF-8.
    (tmp_path / "in it" / "long").write_bytes(b"".join(b"0 %d 0.25 1 1\r\n" % i for i in range(200_000)))
    (tmp_path / "in it" / "line").write_bytes(b"0 5 5" + b" " * (5 << 19) + b"5 5\n0 6 6 6 6")
    (tmp_path / "in it" / "latin").write_bytes(b"\xe9 4 4 4 4\n")
    (tmp_path / "in it" / "link").symlink_to(tmp_path / "in it" / "a b")
    whole = lambda df: sorted(map(tuple, df.filter("trim(line) <> ''").selectExpr("path", "hex(line)").collect()))
    theirs = spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "in it")).selectExpr("value AS line", "_metadata.file_path AS path")
    ours = labels.read_lines(spark, str(tmp_path / "in it"))
    assert "BatchScan label_lines" in ours._jdf.queryExecution().toString()
    assert whole(ours) == whole(theirs)
    assert whole(labels.read_lines(spark, f"file:{tmp_path}/in%20it/../in it/long")) == whole(theirs.filter("path LIKE '%long'"))
    assert labels.read_lines(spark, f"{tmp_path}/in it/[ax]*").select("path").distinct().count() == 4


def test_tasks_and_listing_do_not_grow_with_the_folders(spark, tmp_path):
    for i in range(3_000):
        (tmp_path / f"field_id={i}").mkdir()
        (tmp_path / f"field_id={i}" / "labels.txt").write_text(f"0 {i}.5 2 0 0\n")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "listing")
    centers = labels.read_centers(spark, str(tmp_path), 100, 80)
    assert not tracker.getJobIdsForGroup("listing")
    assert centers.rdd.getNumPartitions() <= 16
    rows = centers.collect()
    spark.sparkContext._jsc.sc().clearJobGroup()
    assert sorted(r["x"] for r in rows) == [i + 0.5 for i in range(3_000)]


def test_files_are_dealt_by_size(tmp_path):
    for i in range(100):
        (tmp_path / f"{i}.txt").write_bytes(b"0 1 1 1 1\n" * (300_000 if i == 3 else 20_000 if i % 2 else 1))
    groups = labels.LabelReader({"path": f"file:{tmp_path}", "tasks": "4"}).partitions()
    sizes = [sum((tmp_path / f.rsplit("/", 1)[1]).stat().st_size for f in g.files) for g in groups]
    assert sum(len(g.files) for g in groups) == 100 and 4 <= len(groups) <= 7
    assert sorted(sizes)[-2] <= 5 << 20
    assert [g.files for g in labels.LabelReader({"path": f"file:{tmp_path}", "tasks": "1"}).partitions()] != []
