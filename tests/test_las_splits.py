"""A file that Spark reads in splits gives the tables of the same file read whole."""

import random

import pytest

from curveframe.sources import las

HEADER = """~Version
 VERS. 2.0 : version
 WRAP. {wrap} : lines per step
 DLM. {delimiter} : delimiter
~Well
# nothing here
 NULL. -9 : null
 WELL. Split {name} : well
~Curve
 DEPT.M : depth
 TIME. : clock
 DATE. : day
 GR.GAPI : gamma
 NOTE. : text
~Parameter
 BS.MM 216 : bit size
~Other
 free text
~ASCII
"""


def rows_of(seed, count):
    source = random.Random(seed)
    for row in range(count):
        value = source.choice(["-9", str(source.randrange(1000)), f"{source.random():.3f}"])
        depth = 100 + row / 2 if source.random() > 0.02 else -9
        yield [str(depth), f"{row // 3600 % 24:02d}:{row // 60 % 60:02d}:{row % 60:02d}", "03-Feb-24", value, source.choice(["a", "7", "b"])]


def write(folder, name, style, count=250):
    rows = list(rows_of(len(name), count))
    separator = {"COMMA": ", ", "TAB": "\t", "SPACE": "  "}[style.split("-")[0]]
    if style == "SPACE-wrapped":
        # Rows begin and end anywhere in a line.
        cells = [cell for row in rows for cell in row]
        body = ["  ".join(cells[at : at + 7]) for at in range(0, len(cells), 7)]
    else:
        body = [separator.join(row) for row in rows]
    body[5:5] = ["", "# a comment"]
    tail = "\n~ASCII again\n1 2 3 4 5\n" if style == "TAB" else "\n"
    text = HEADER.format(wrap="NO", delimiter=style.split("-")[0], name=name) + "\n".join(body) + tail
    (folder / f"{name}.las").write_text(text)
    return len(text)


def content(tables):
    found = {}
    for name in ("sources", "datasets", "channels", "axis", "samples", "preview_samples", "candidates", "status", "warnings", "preserved_objects"):
        frame = getattr(tables, name)
        found[name] = sorted(str(row) for row in frame.select(sorted(frame.columns)).collect())
    return found


@pytest.fixture
def small_splits(spark):
    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield cut
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_splits_equal_the_whole(spark, tmp_path, small_splits):
    folder = tmp_path / "las"
    folder.mkdir()
    sizes = [write(folder, name, style) for name, style in (("one", "SPACE"), ("two", "COMMA"), ("three", "TAB"), ("four", "SPACE-wrapped"))]
    (folder / "bad.las").write_text("~V\nVERS. 2.0 :\n~C\nDEPT.M :\nGR. :\n~A\n1 2 3\n")
    (folder / "empty.las").write_text("no section\n")
    (folder / "note.txt").write_text("x")
    whole = content(las.ingest_folder(spark, str(folder), take_first=True))
    assert len(whole["status"]) == 6 and len(whole["samples"]) > 4 * 4 * 240
    small_splits(min(sizes) // 5)
    for part_cells in (35, las.PART_CELLS):
        parts = content(las.ingest_folder(spark, str(folder), take_first=True, whole_bytes=0, part_cells=part_cells))
        for name, rows in whole.items():
            assert parts[name] == rows, (name, part_cells)


def test_samples_are_not_shuffled(spark, tmp_path):
    write(tmp_path, "one", "SPACE")
    tables = las.ingest_folder(spark, str(tmp_path), take_first=True)
    for frame in (tables.samples, tables.axis):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()


def test_latin_letters(spark, tmp_path):
    text = "~V\nVERS. 2.0 :\n~W\nWELL. Bohrung Süd : Größe\n~C\nDEPT.M : Tiefe\nTEMP.°C : Wärme\n~A\n1 20\n2 21\n"
    for name, encoding in (("latin.las", "latin-1"), ("unicode.las", "utf-8")):
        (tmp_path / name).write_bytes(text.encode(encoding))
    for whole_bytes in (0, las.WHOLE_BYTES):
        tables = las.ingest_folder(spark, str(tmp_path), whole_bytes=whole_bytes)
        assert [r.well_name for r in tables.datasets.collect()] == ["Bohrung Süd"] * 2
        assert [(r.unit, r.description) for r in tables.channels.collect()] == [("°C", "Wärme")] * 2
