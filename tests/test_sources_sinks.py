"""CSV, ranges, pages, metadata, tables, envelopes."""

import json
import random

import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dockyard.sinks.envelope import CRLF, batch_envelopes
from dockyard.sinks.files import load_table, stage_csv, staged_path, write_csv
from dockyard.sinks.records import record_documents
from dockyard.schema import ORDER_COLUMNS
from dockyard.sources.landing import read_pages
from dockyard.sources.pages import (
    column_dictionary,
    linked_scan,
    mapping_of,
    page_columns,
    paged_scan,
    probe_table,
    table_dictionary,
    union_pages,
)
from dockyard.sources import quoted
from dockyard.sources.quoted import csv_records, state_after
from dockyard.sources.tables import range_slice, read_csv


def put(tmp_path, name, text):
    (tmp_path / name).write_bytes(text.encode("utf-8"))
    return str(tmp_path / name)


def test_csv_cells_are_text(spark, tmp_path):
    text = 'No,S,Name,S,Ünit\r\n1,"say ""hi"", ok","two\nlines",,é\r\n007,, x ,--,\r\n'
    rows, ragged = read_csv(spark, put(tmp_path, "a.csv", text))
    assert rows.columns == ["No", "S", "Name", "S__2", "Ünit"]
    assert {tuple(r) for r in rows.collect()} == {("1", 'say "hi", ok', "two\nlines", "", "é"), ("007", "", " x ", "--", "")}
    assert rows.count() == 2 and ragged.count() == 0


def test_ragged_rows_are_quarantined(spark, tmp_path):
    rows, ragged = read_csv(spark, put(tmp_path, "a.csv", "a,b,c\n1,2,3\n1,2\n1,2,3,4\n"))
    assert [tuple(r) for r in rows.collect()] == [("1", "2", "3")]
    assert sorted(r["raw"] for r in ragged.collect()) == ["1,2", "1,2,3,4"]


def test_missing_csv(spark, tmp_path):
    assert read_csv(spark, str(tmp_path / "none.csv")) is None


def test_csv_position_follows_the_file(spark, tmp_path):
    path = put(tmp_path, "a.csv", "k,v\n" + "".join(f"{i},{i}\n" for i in range(50)))
    rows, _ = read_csv(spark, path, with_position=True)
    assert [r["k"] for r in rows.orderBy("_pos").collect()] == [str(i) for i in range(50)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a\\b", 'q"', ""), ("x,y", " s ", "l\n2")], "p string, q string, r string")
    write_csv(df, str(tmp_path / "out"))
    rows, ragged = read_csv(spark, str(tmp_path / "out"))
    assert {tuple(r) for r in rows.collect()} == {tuple(r) for r in df.collect()}
    assert ragged.isEmpty()


@pytest.mark.parametrize("a1, columns, positions", [
    (None, "abc", range(2, 12)), ("A2:B4", "ab", range(2, 5)), ("A1:B4", "ab", range(2, 5)), ("B:C", "bc", range(2, 12)),
    ("C9:C", "c", range(9, 12)), ("3:4", "abc", range(3, 5)), ("B5", "b", [5]), ("B2:Z3", "bc", range(2, 4)),
])
def test_range_slice(spark, a1, columns, positions):
    sheet = spark.range(2, 12).select(F.col("id").alias("_pos"), *[F.concat(F.lit(c), "id").alias(c) for c in "abc"])
    out = range_slice(sheet, a1)
    assert out.columns == list(columns)
    assert {tuple(r) for r in out.collect()} == {tuple(f"{c}{p}" for c in columns) for p in positions}


def test_bad_range(spark):
    with pytest.raises(ValueError):
        range_slice(spark.range(1), "not a range")


def pages(spark, *bodies, statuses=None):
    statuses = statuses or [200] * len(bodies)
    rows = [(i, s, b if isinstance(b, str) else json.dumps(b)) for i, (b, s) in enumerate(zip(bodies, statuses))]
    return spark.createDataFrame(rows, "page_no long, status int, body string")


def page(*records, link=True):
    return {"value": list(records), **({"@odata.nextLink": "x"} if link else {})}


FIRST = page({"@odata.etag": "e", "c1": 1, "c2": "b", "Id": "X", "id": "y"})


def test_paged_scan_columns_come_from_the_first_record(spark):
    scan = paged_scan(pages(spark, FIRST, page({"c1": 2, "c3": "ignored"}, link=False)))
    assert scan.columns == ["c1", "c2", "Id", "id"]
    assert {tuple(r) for r in scan.collect()} == {("1", "b", "X", "y"), ("2", None, None, None)}


def test_paged_scan_indexes(spark):
    assert paged_scan(pages(spark, FIRST), [0, -1, 99]).columns == ["c1", "id"]


def test_reading_stops(spark):
    more = page({"c1": 9})
    assert paged_scan(pages(spark, FIRST, page(), more)).count() == 1
    assert paged_scan(pages(spark, FIRST, {"@odata.nextLink": "x"}, more)).count() == 1
    assert paged_scan(pages(spark, FIRST, page({"c1": 2}, link=False), more)).count() == 2
    assert paged_scan(pages(spark, page(), FIRST)).count() == 0
    assert paged_scan(pages(spark, FIRST, more, more)).count() == 3
    assert paged_scan(pages(spark, {**FIRST, "@odata.nextLink": None}, more)).count() == 1
    assert paged_scan(pages(spark, FIRST).where("page_no < 0")).columns == []


def test_failed_page_gives_none_only_when_reached(spark):
    assert paged_scan(pages(spark, FIRST, "busy", FIRST, statuses=[200, 503, 200])) is None
    assert paged_scan(pages(spark, FIRST, page(), "busy", statuses=[200, 200, 503])).count() == 1


def test_landed_pages_are_read(spark, tmp_path):
    pages(spark, FIRST).write.json(str(tmp_path / "pages"))
    assert page_columns(read_pages(spark, str(tmp_path / "pages")), 0) == ["c1", "c2", "Id", "id"]


def test_union_takes_the_first_schema(spark):
    a = spark.createDataFrame([("1", "2")], "x string, y string")
    b = spark.createDataFrame([("3", "4")], "z string, x string")
    assert sorted(union_pages([a, b]).collect()) == [("1", "2"), ("4", None)]


def entity(name, label):
    return {"LogicalName": name, "SchemaName": name, "DisplayName": {"UserLocalizedLabel": label}}


def test_table_dictionary(spark):
    docs = pages(
        spark,
        {"value": [entity("t1", {"Label": "Same"}), entity("t2", None), entity("t3", {"Label": ""}), entity("t4", {"Label": "Same"})]},
        {"value": [entity("t5", {"Label": "Other"}), {"DisplayName": {"UserLocalizedLabel": {"Label": "Nameless"}}}]},
    )
    assert {tuple(r) for r in table_dictionary(docs).collect()} == {("Same", "t4"), ("Other", "t5"), ("Nameless", "")}


def attribute(name, custom, *labels):
    flag = {} if custom is None else {"IsCustomAttribute": custom}
    return {"LogicalName": name, **flag, "DisplayName": {"LocalizedLabels": [{"Label": x} for x in labels]}}


def test_column_dictionary(spark):
    docs = pages(spark, {"value": [
        attribute("a", True, "A", "other"), attribute("b", False, "B"), attribute("c", None, "C"),
        attribute("d", True), attribute("e", True, ""), attribute("f", True, "A"), attribute("g", True, "G"),
    ]})
    dictionary = column_dictionary(docs)
    assert mapping_of(dictionary, ["A", "G", "unknown"]) == {"A": "f", "G": "g"}
    assert dictionary.count() == 2


def test_record_documents_leave_the_receipt_time_out(spark):
    flat = spark.createDataFrame([("v",) * 25], ", ".join(f"`{c}` string" for c in [*ORDER_COLUMNS, "received_at_local"]))
    record = json.loads(record_documents(flat, {"id": "cr_id"}).first()["record"])
    assert list(record) == ["cr_id", *ORDER_COLUMNS[1:]]


def test_table_load_overwrites(spark, tmp_path):
    name, where = "load_test", str(tmp_path / "table")
    assert load_table(spark, put(tmp_path, "a.csv", "a,b\n1,x\n2,y\n"), name, where).count() == 2
    rows = load_table(spark, put(tmp_path, "b.csv", "a,c\n3,z\n"), name, where)
    assert rows.columns == ["a", "c"] and [tuple(r) for r in rows.collect()] == [("3", "z")]
    assert load_table(spark, str(tmp_path / "b.csv"), "") is None
    assert load_table(spark, str(tmp_path / "none.csv"), name) is None
    assert probe_table(spark, name).count() == 1
    assert probe_table(spark, "no_such_table") is None
    spark.sql(f"DROP TABLE {name}")


def test_staged_files_are_found_by_the_loader(spark, tmp_path):
    path = stage_csv(spark.range(3), str(tmp_path), "ws", "lake", "out.csv")
    assert path == f"{tmp_path}/ws/lake.Lakehouse/Files/output/out.csv" == staged_path(str(tmp_path), "ws", "lake", "/x/out.csv")
    assert read_csv(spark, path)[0].count() == 3


def test_envelope_framing(spark):
    df = spark.createDataFrame([(5, '{"a":null}'), (0, '{"a":1}'), (4, '{"a":2}')], "pos long, record string")
    rows = {r["batch_id"]: r for r in batch_envelopes(df, "pos", "record", "https://host/api", "order", 5).collect()}
    assert {b: r["n_records"] for b, r in rows.items()} == {0: 2, 1: 1}

    def part(batch, number, record):
        return [f"--changeset_{batch}", "Content-Type: application/http", "Content-Transfer-Encoding: binary",
                f"Content-ID: {number}", "", "POST https://host/api/orders HTTP/1.1", "Content-Type: application/json", "", record]

    assert rows[0]["body"].split(CRLF) == [
        "--batch_0", "Content-Type: multipart/mixed; boundary=changeset_0", "",
        *part(0, 0, '{"a":1}'), *part(0, 1, '{"a":2}'), "--changeset_0--", "--batch_0--",
    ]
    assert rows[1]["body"].split(CRLF)[3:12] == part(1, 0, '{"a":null}')


def test_load_table_keeps_ragged_rows_beside_the_table(spark, tmp_path):
    name = f"ragged_{uuid.uuid4().hex}"
    loaded = load_table(spark, put(tmp_path, "r.csv", "a,b\n1,x\n2\n3,z,9\n"), name, str(tmp_path / "t"))
    assert [tuple(r) for r in loaded.collect()] == [("1", "x")]
    assert sorted(r["raw"] for r in spark.table(f"{name}_ragged").collect()) == ["2", "3,z,9"]


def test_files_are_read_by_their_own_headers(spark, tmp_path):
    put(tmp_path, "a 1.csv", "a,b\n1,2\n")
    put(tmp_path, "b[2].csv", "b,a\r\n20,10\r\nragged\r\n")
    put(tmp_path, "c%3.csv", '\n"c",a\n"x\ny",100\n')
    for split in (False, True):
        rows, ragged = read_csv(spark, str(tmp_path), split=split, with_position=True)
        assert rows.columns == ["a", "b", "c", "_pos"]
        assert {tuple(r) for r in rows.drop("_pos").collect()} == {("1", "2", ""), ("10", "20", ""), ("100", "", "x\ny")}
        assert [r["raw"].strip() for r in ragged.collect()] == ["ragged"]


@pytest.mark.parametrize("line, out, inside", [
    ("a,b", False, True), ('"a', True, False), ('a,"b""', True, False), ('5" pipe,x', False, False), ('x",y', False, False), ('"a","b', True, True),
    ('""', False, True), ('"""', True, False), ('x"",y', False, True), ('"a"b,"c"', False, False), ("", False, True),
])
def test_quotes_open_cells_at_their_beginning_only(line, out, inside):
    assert state_after(line, False) is out
    if inside is not None:
        assert isinstance(state_after(line, True), bool)


def quoted_file(n):
    lines = ["no,text,more"]
    for i in range(n):
        cell = ["plain", f'"two\nlines {i}"', '"say ""x"", y"', f'"{"deep" * 30}\n\n{"line" * 30}\n,"', '5" pipe'][i % 5]
        lines.append(f"{i},{cell},{'' if i % 3 else 'z'}")
    return "\n".join(lines) + "\n"


@pytest.mark.parametrize("size", ["300", "4096"])
def test_ranges_of_a_quoted_file_give_the_same_rows(spark, tmp_path, size):
    """Ranges shorter than a record and longer ones: the rows are those of a reader that takes the file whole."""
    path = put(tmp_path, "big.csv", quoted_file(400))
    whole = sorted(map(tuple, read_csv(spark, path)[0].collect()))
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    for key in keys:
        spark.conf.set(key, size)
    try:
        rows, ragged = read_csv(spark, path, split=True, with_position=True)
        assert csv_records(spark, path).select("block").distinct().count() > 3
        found = rows.orderBy("_pos").collect()
        assert [r["no"] for r in found] == [str(i) for i in range(400)]
        assert sorted(tuple(r)[:-1] for r in found) == whole and ragged.isEmpty()
    finally:
        for key in keys:
            spark.conf.unset(key)


def test_an_open_quote_takes_the_rest_of_its_file_alone(spark, tmp_path):
    put(tmp_path, "a.csv", 'a,b\n1,"open\n2,3\n')
    put(tmp_path, "b.csv", "a,b\n4,5\n")
    rows, _ = read_csv(spark, str(tmp_path), split=True)
    assert ("4", "5") in {tuple(r) for r in rows.collect()} and rows.count() <= 2


def linked(spark, *rows):
    return spark.createDataFrame([(link, n, status, json.dumps(body)) for n, (link, status, body) in enumerate(rows)], "link string, page_no long, status int, body string")


def to(link, *records):
    return {"value": list(records), **({"@odata.nextLink": link} if link else {})}


def test_pages_follow_their_links(spark):
    found, notes = linked_scan(linked(
        spark, ("p3", 200, to(None, {"x": 3})), ("p1", 200, to("p2", {"@odata.etag": "e", "x": 1, "y": "a"})), ("lost", 200, to("p3", {"x": 9})), ("p2", 200, to("p3", {"x": 2, "y": None})),
    ), "p1", typed=True)
    assert found.dtypes == [("x", "bigint"), ("y", "string")]
    assert sorted(map(tuple, found.collect())) == [(1, "a"), (2, None), (3, None)]
    assert [(r["link"], r["note"]) for r in notes.collect()] == [("lost", "unreachable")]


def test_linked_scan_ends(spark):
    one = {"x": 1}

    def scan(*rows):
        found, notes = linked_scan(linked(spark, *rows), "a")
        return None if found is None else found.count(), sorted((r["link"], r["note"]) for r in notes.collect())

    assert scan(("a", 200, to("b", one)), ("b", 200, to("a", one))) == (2, [("b", "cyclic")])
    assert scan(("a", 200, to("b", one)), ("b", 200, to("c")), ("c", 200, to(None, one))) == (1, [("b", "behind the end"), ("c", "behind the end")])
    assert scan(("a", 200, to("b", one))) == (1, [("b", "missing")])
    assert scan(("a", 200, to("b", one)), ("b", 503, {})) == (None, [("b", "failed")])
    assert scan(("a", 200, to("b")), ("b", 503, {}))[0] == 0
    assert scan(("a", 200, to("b", one)), ("a", 200, to(None, one, one))) == (2, [])
    assert scan(("z", 200, to("b", one))) == (0, [("z", "unreachable")])


def test_typed_values(spark):
    scan = paged_scan(pages(
        spark, page({"n": 1, "d": 1.25, "b": True, "s": "x", "mix": 1, "obj": {"a": 1}, "none": None, "it's": 5}),
        page({"n": None, "d": 3, "b": False, "mix": "two", "obj": [1]}, link=False),
    ), typed=True)
    kinds = dict(scan.dtypes)
    assert (kinds["n"], kinds["b"], kinds["s"], kinds["mix"], kinds["obj"], kinds["it's"]) == ("bigint", "boolean", "string", "string", "string", "bigint")
    assert kinds["d"].startswith("decimal") and kinds["none"] == "string"
    rows = {r["b"]: r.asDict() for r in scan.collect()}
    assert rows[True]["n"] == 1 and rows[False]["n"] is None and rows[False]["mix"] == "two" and rows[True]["mix"] == "1"
    assert rows[True]["obj"] == '{"a":1}' and rows[False]["obj"] == "[1]" and float(rows[False]["d"]) == 3


def test_ranges_are_cut_as_line_by_line():
    """Vectorised states and records against ``state_after`` line by line, over batches and ranges of any size."""
    rng = random.Random(3)
    for _ in range(300):
        rows = [(f, 10 * b, "".join(rng.choices('"",\rxé', k=rng.randint(0, 7)))) for f in "ab" for b in range(rng.randint(1, 3)) for _ in range(rng.randint(1, 6))]
        size = rng.randint(1, 9)
        batches = [pa.RecordBatch.from_pylist([dict(zip(("file", "block", "value"), r, strict=True)) for r in rows[i : i + size]]) for i in range(0, len(rows), size)]
        want_states, want_records = {}, []
        inside, before = False, None
        for file, block, line in rows:
            state = want_states.setdefault((file, block), [False, True, False])
            state[2] = state[2] or not state[1]
            state[:2] = [state_after(line, state[0]), state_after(line, state[1])]
            if file != before:
                inside, before = False, file
            text = line.removesuffix("\r")
            if inside:
                want_records[-1] += "\n" + text
            else:
                want_records.append(text)
            inside = state_after(line, inside)
        got = {(r["file"], r["block"]): [r["if_out"], r["if_in"], r["begins"]] for b in quoted._ranges(iter(batches)) for r in b.to_pylist()}
        assert got == want_states
        # Ranges that begin inside, and where their open record began.
        owners, inside, began = {}, False, None
        for (file, block), state in want_states.items():
            if block == 0:
                inside, began = False, None
            if inside:
                owners[file, block] = began
            if not inside or state[2]:
                began = block
            inside = state[inside]
        found = [r for b in quoted._records(owners)(iter(batches)) for r in b.to_pylist()]
        texts: dict[tuple, list[str]] = {}
        for r in found:
            texts.setdefault((r["file"], r["number"], r["block"]) if r["owner"] is None else (r["file"], r["owner"]), []).append(r["text"])
        assert sorted("\n".join(t) for t in texts.values()) == sorted(want_records)
