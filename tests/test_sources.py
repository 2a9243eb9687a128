import gzip
import json
import zlib

import pytest
from pyspark.sql import functions as F

from tracewell.operators import books
from tracewell.sources import chunks
from tracewell.streaming import ingest

SLICE = "17000000000001-ab12"


def body(events, **more):
    return json.dumps({"visitorId": "visitor01", "sliceId": SLICE, "recorderVersion": "1", "envelope": {"language": "en", "screen": {"width": 10, "height": 20}}, "events": events, "errors": [], **more}).encode()


def event(t, seq=0, **data):
    return {"type": 3, "timestamp": t, "counter": f"{t:013d}{seq:06d}", "data": {"source": 3, **data}}


def write(root, name, wire):
    path = root / "abc" / "2024-01-02" / "visitor01" / SLICE / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(wire)


def load(spark, root, manifest=None):
    manifest = manifest if manifest is not None else spark.createDataFrame([], "key string, etag string, uploaded_ms long")
    return chunks.decoded(chunks.new_objects(spark, str(root), manifest))


def test_chunks_in_all_wrappings_and_rejects_with_reasons(spark, tmp_path):
    write(tmp_path, "1.json.gz", gzip.compress(body([event(1), event(2), {"type": "x"}])))
    write(tmp_path, "2.json.gz", zlib.compress(body([event(2), event(3)])))
    raw = zlib.compressobj(wbits=-15)
    write(tmp_path, "3.json.gz", raw.compress(body([event(4)])) + raw.flush())
    write(tmp_path, "4.json.gz", b"junk")
    write(tmp_path, "5.json.gz", gzip.compress(json.dumps({"visitorId": "v"}).encode()))
    rows = load(spark, tmp_path)
    assert {(r.key[-9:], r.reason): r.events for r in chunks.rejects(rows).collect()} == {("1.json.gz", "event type is no whole number"): 1, ("4.json.gz", "corrupt"): 1, ("5.json.gz", "no sliceId"): 1}
    kept = chunks.first_of_each(rows)
    assert sorted(r.timestamp for r in kept.collect()) == [1, 2, 3, 4]
    assert kept.select("snippet").distinct().collect()[0][0] == "abc"


def test_cutting_and_doubling_chunks_changes_nothing(spark, tmp_path):
    events = [event(t) for t in range(20)]
    write(tmp_path / "a", "1.json.gz", gzip.compress(body(events)))
    for k in range(4):
        write(tmp_path / "b", f"{k}.json.gz", gzip.compress(body(events[k * 4 : k * 4 + 8][::-1])))
    one, two = (chunks.first_of_each(load(spark, tmp_path / x)).select("content_hash", "timestamp") for x in "ab")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_what_is_held_is_not_read_again(spark, tmp_path):
    write(tmp_path, "1.json.gz", gzip.compress(body([event(1)])))
    held = chunks.listing(spark, str(tmp_path)).select("key", "etag", "uploaded_ms")
    held = spark.createDataFrame(held.collect(), held.schema)
    write(tmp_path, "2.json.gz", gzip.compress(body([event(2)])))
    assert [r.timestamp for r in load(spark, tmp_path, held).collect()] == [2]


def test_a_batch_of_moves_stands_at_its_end():
    assert chunks.clock({"type": 3, "timestamp": 100, "counter": "", "data": {"source": 1, "positions": [{"timeOffset": -40}, {"timeOffset": -3}]}}) == 97


def test_identity_is_sorted_ascii_json():
    assert chunks.canonical_json({"b": "é", "a": [1, 2.5]}) == '{"a":[1,2.5],"b":"\\u00e9"}'


def test_stores_and_prefixes_refuse():
    for url in ("s3://b/path", "http://x", "s3://b?x=1"):
        with pytest.raises(ValueError):
            chunks.store_root(url)
    assert chunks.store_root("s3://bucket") == "s3a://bucket"


def test_prefixes_are_literal(spark):
    o = spark.createDataFrame([("a_b/1",), ("axb/1",)], "key string")
    assert [r.key for r in books.under_prefix(o, "a_").collect()] == ["a_b/1"]
    with pytest.raises(ValueError):
        books.under_prefix(o, "a*")


def test_a_torn_ledger_line_is_an_error(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"ts": "2024-01-01", "usd": 1.5}\n{"ts": "2024')
    with pytest.raises(Exception):
        chunks.read_ledger(spark, str(tmp_path / "l.jsonl")).collect()


def test_a_wall_refuses_at_the_cap(spark):
    ledger = spark.createDataFrame([("2024-01-01", 1.0), ("2024-02-01", 2.0)], "ts string, usd double")
    assert books.wall(ledger, F.lit("2024-01-01"), 3.0).first().refused
    assert not books.wall(ledger, F.lit("2024-01-01"), 3.1).first().refused
    assert books.wall(ledger.limit(0), F.lit("2024-01-01"), 0.0).first().refused


def test_claims_and_citations(spark):
    claims = spark.createDataFrame([("a", 1, "OBSERVATION", None, "S1"), ("a", 2, "OBSERVATION", None, "S9"), ("a", 3, "INFERENCE", [], None), ("a", 4, "INFERENCE", [7], None), ("a", 5, "INFERENCE", [1], None)], "answer_id string, claim_id int, claim_type string, supporting array<int>, label string")
    labels = spark.createDataFrame([("S1", 0, 90_000), ("S2", 0, 5000)], "label string, start_ms long, end_ms long")
    assert {r.claim_id: r.why for r in books.structural_failures(claims, labels).collect()} == {2: "unknown label", 3: "no support", 4: "unknown support"}
    answers = spark.createDataFrame([("a", "x [S1 01:00.000] y [S2 00:09.000] z [00:01.000] [S7 00:00.001]")], "answer_id string, text string")
    why = {r.cite: r.why for r in books.citation_violations(books.citations(answers), labels).collect()}
    assert why == {"[S2 00:09.000]": "bounds", "[00:01.000]": "form", "[S7 00:00.001]": "label"}


def test_micro_batches_with_late_and_repeated_events(spark, tmp_path):
    source, store = tmp_path / "in", ingest.Store(spark, str(tmp_path / "store"))
    source.mkdir()

    def put(name, rows):
        lines = [json.dumps({"visitor_id": "v", "snippet": "s", "timestamp": t, "counter": str(t), "type_str": k, "content_hash": f"{t}{k}"}) for t, k in rows]
        (source / name).write_text("\n".join(lines))
        stream = spark.readStream.schema(ingest.EVENT).json(str(source))
        ingest.start(stream, store, str(tmp_path / "ck")).awaitTermination()

    put("1.json", [(0, "PageLoad"), (50 * 60000, "PageLoad")])
    assert ingest.current_sessions(store).count() == 2
    put("2.json", [(25 * 60000, "Click"), (0, "PageLoad")])
    one = ingest.current_sessions(store).collect()
    assert len(one) == 1 and (one[0].acts, one[0].pageviews) == (3, 2)
