import io
import json
import os
import random

import pytest

from stockloom.session import fresh_folder
from stockloom.sources import json_lists, tables


def text(rng):
    return "".join(rng.choices('a"\\[]{},:é\n ', k=rng.randint(0, 6)))


def document(rng):
    rows = [rng.choice([{text(rng): [1, [2], {"a": {"b": text(rng)}}], "b": text(rng)}, text(rng), 3, None, [], {}]) for _ in range(rng.randint(0, 12))]
    value = {text(rng) + "1": rng.choice([text(rng), [1, 2], {"rows": [9, 8]}, 4]), "rows": rows, text(rng) + "2": [{"rows": [7]}]}
    return json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])).encode(), rows


def cut(data, key, size):
    """What the tasks do, block after block."""
    file, state, depth, blocks, begins, ends = io.BytesIO(data), 0, 0, [], [], []
    for start in range(0, len(data), size):
        stop = min(start + size, len(data))
        blocks.append((start, stop, state, depth))
        for _, _, at, kinds, opens, depths, _, _ in json_lists.pieces(io.BytesIO(data), *blocks[-1], size=2):
            names = at[(kinds == json_lists.QUOTE) & opens & (depths == 1)].tolist()
            begins += [p for p in (json_lists.is_list_of(file, n, key) for n in names) if p is not None]
            ends += at[(kinds == json_lists.CLOSE) & (depths == 1)].tolist()
        now = json_lists.change(file, start, stop, size=3)
        state, depth = now[state][0], depth + now[state][1]
    assert (state, depth) == (0, 0) and len(begins) == 1
    last = min(e for e in ends if e >= begins[0])
    parts = [e for b in blocks if b[1] > begins[0] and b[0] <= last for e in json_lists.elements(file, *b, begins[0], last)]
    return [json.loads(p) for p in parts if p.strip()]


@pytest.mark.parametrize("seed", range(40))
def test_any_block_border(seed):
    data, rows = document(random.Random(seed))
    for size in (1, 2, 3, 7, 50):
        assert cut(data, "rows", size) == rows


def write(folder, name, value, **how):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as out:
        out.write(json.dumps(value, **how))


def local(folder):
    return folder.removeprefix("file:").replace("//", "/")


def test_one_document_by_many_tasks(spark):
    rng = random.Random(3)
    rows = [{"id": k, "note": text(rng) * 9, "mixed": "x" if k % 50 == 0 else k, "price": 1.5 if k % 2 else 2, "in": {"a b": [k, None]}} for k in range(3000)]
    rows[7]["late"], rows[5]["note"] = True, 'y"\\' * 40_000
    folder = f"{local(fresh_folder(spark, 'json'))}/in"
    write(folder, "one.json", {"x": ["rows", {"rows": [0]}], "ro\u0077s ": 1, "rows": rows, "n": 2}, ensure_ascii=False)
    cuts = json_lists.json_list(spark, folder, "rows", block=20_000)
    assert sorted(json.loads(r.value)["id"] for r in cuts.collect()) == list(range(3000))
    assert cuts.rdd.getNumPartitions() > 10
    busy = cuts.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(n > 0 for n in busy) > 10
    got = json_lists.read_json_list(spark, folder, "rows", block=20_000)
    kinds = dict(got.dtypes)
    assert kinds == {"id": "bigint", "in": "struct<a b:array<bigint>>", "late": "boolean", "mixed": "string", "note": "string", "price": "double"}
    made = {r.id: r for r in got.collect()}
    for row in rows:
        r = made[row["id"]]
        assert (r.note, r.mixed, r.price, r.late, r["in"]["a b"]) == (row["note"], str(row["mixed"]), row["price"], row.get("late"), [row["id"], None])


def test_several_documents_and_odd_ones(spark):
    folder = f"{local(fresh_folder(spark, 'json'))}/in"
    write(folder, "a.json", {"rows": [{"a": 1}]})
    write(folder, "b.json", {"rows": []}, indent=2)
    write(folder, "c d.json", {"other": [{"a": 5}]})
    write(folder, "e.json", {"rows": [{"a": 2}, {"b": "z"}]}, indent=2)
    open(f"{folder}/empty.json", "w").close()
    got = json_lists.read_json_list(spark, folder, "rows", block=5)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, None), (2, None), (None, "z")], key=repr)
    with pytest.raises(ValueError, match="no list"):
        json_lists.json_list(spark, folder, "rows2")
    with open(f"{folder}/cut.json", "w") as out:
        out.write('{"rows": [{"a": 1}, {"a"')
    with pytest.raises(Exception, match="no whole JSON document"):
        json_lists.json_list(spark, folder, "rows")


def test_table_by_blocks(spark):
    folder = local(fresh_folder(spark, "json"))
    write(f"{folder}/in", "a.json", {"rows": [{"a": k, "s": "é" * k} for k in range(50)]}, ensure_ascii=False)
    made = tables.table_from_json(spark, f"{folder}/in", "rows", "by_blocks", f"{folder}/table", block=64)
    assert sorted((r.a, r.s) for r in made.collect()) == [(k, "é" * k) for k in range(50)]
    assert "created_timestamp" in made.columns
    spark.sql("DROP TABLE by_blocks")


def test_types_of_columns():
    kind = "OBJECT<a: BIGINT, `b OBJECT`: DECIMAL(3,1), OBJECT: VOID, c: ARRAY<OBJECT<d: VARIANT>>, e: DECIMAL(20,0)>"
    assert json_lists.column_type(kind) == "STRUCT<a: BIGINT, `b OBJECT`: DOUBLE, OBJECT: STRING, c: ARRAY<STRUCT<d: STRING>>, e: DECIMAL(20,0)>"


def test_tasks_do_not_grow_with_the_blocks(spark, frame):
    folder = fresh_folder(spark, "blocks")
    os.makedirs(folder)
    for n in range(6):
        with open(f"{folder}/{n}.json", "w") as f:
            json.dump({"rows": [{"a": 1000 * n + i} for i in range(400)]}, f)
    most = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = json_lists.json_list(spark, folder, "rows", block=64)
    assert rows.rdd.getNumPartitions() <= most
    assert sorted(json.loads(r.value)["a"] for r in rows.collect()) == [1000 * n + i for n in range(6) for i in range(400)]


def test_documents_are_whole_after_a_join_by_shuffle(spark, frame):
    """The rows of a document, its top and its end go to one file, also where a join is found to be one for a broadcast only after its shuffle."""
    from checks.files import table_from_large_json

    folder = fresh_folder(spark, "orders")
    rows = [(7000 * i, i, i / 4, "O", f"2020-01-{i % 28 + 1:02d}", "1-URGENT") for i in range(20)]
    frame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string, o_orderdate string, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        got = table_from_large_json(spark, folder).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(r.o_orderkey for r in got) == [r[0] for r in rows]
    assert {r.o_orderkey: r.o_totalprice for r in got} == {r[0]: r[2] for r in rows}
