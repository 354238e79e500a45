from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sift.operators import mapping
from sift.params import Board
from sift.sources import collect, payloads
from sift.sources.boards import boards_frame, join_boards, with_ingest_seq
from sift.sources.payloads import job_rows


@pytest.fixture
def landed(spark):
    def make(*bodies, token="acme"):
        rows = [(token, "f", n, b if isinstance(b, str) else json.dumps(b)) for n, b in enumerate(bodies)]
        return spark.createDataFrame(rows, "token string, landed string, landed_pos bigint, payload string")

    return make


@pytest.fixture
def mapped(spark, landed):
    def make(*bodies, boards=(Board("acme"),)):
        source = collect.board_source(lambda _: landed(*bodies), boards)
        return source.load(spark, 0)

    return make


def job(**members):
    return {"title": "T", "absolute_url": "u", **members}


def one(frame):
    (row,) = frame.collect()
    return row


def test_full_posting(mapped):
    row = one(mapping.postings(mapped({"jobs": [job(
        title="  Data Analyst \n", absolute_url=" https://x/1 ",
        location={"name": " Remote "}, updated_at="2024-01-02T03:04:05-05:00",
        content={"description": " d ", "requirements": " \t", "responsibilities": "r "},
        departments=[1],
    )]})))
    assert row.title == "Data Analyst" and row.url == "https://x/1"
    assert row.location == "Remote" and row.remote is True
    assert row.description == "d\n\nr"
    assert str(row.published_at) == "2024-01-02 08:04:05"
    assert (row.company, row.source, row.tags) == ("acme", "greenhouse", [])
    assert json.loads(str(row.raw))["departments"] == [1]
    assert tuple(row.ingest_seq) == (0, 0, "f", 0, 0)


def by_pos(frame, column):
    return {r.ingest_seq.pos: r[column] for r in frame.collect()}


def by_body(frame):
    return sorted(r.ingest_seq.landed_pos for r in frame.collect())


LOCATIONS = [
    ({"name": " A "}, "A"), (" B ", "B"), (3, ""), (None, ""), ({}, ""), ({"name": None}, ""),
    ({"name": 0}, ""), ([], ""), ({"name": ""}, ""), (["A"], ""), ({"name": " C", "id": 1}, "C"),
]

CONTENTS = [
    ("<p>html</p>", ""), (None, ""), ({"description": 5, "requirements": "r"}, "r"),
    ({"responsibilities": "c", "description": "a"}, "a\n\nc"), ({}, ""),
    ([{"description": "a"}], ""), ({"description": " ", "requirements": ["x"]}, ""),
]

REMOTE = [
    ({"title": "Distributed systems"}, True), ({"location": "REMOTE"}, True), ({}, None),
    ({"content": {"description": "from anywhere"}}, True), ({"content": "anywhere"}, None),
]


@pytest.mark.parametrize(
    "column,cases",
    [
        ("location", [({"location": given}, want) for given, want in LOCATIONS]),
        ("description", [({"content": given}, want) for given, want in CONTENTS]),
        ("remote", REMOTE),
    ],
    ids=["location", "description", "remote"],
)
def test_member_forms(mapped, column, cases):
    rows = mapping.postings(mapped({"jobs": [job(**members) for members, _ in cases]}))
    assert by_pos(rows, column) == {n: want for n, (_, want) in enumerate(cases)}


@pytest.mark.parametrize("member", ["title", "absolute_url"])
def test_falsy_required_member_drops_the_row(mapped, member):
    blanks = [None, "", "  ", 0, 0.0, False, [], {}, -0.0, "\u2003"]
    rows = mapped({"jobs": [job(**{member: blank}) for blank in blanks]})
    assert mapping.postings(rows).count() == 0 and mapping.rejects(rows).count() == 0


def test_wrong_types_are_rejects(mapped):
    bad = [
        job(title=1), job(title=True), job(title=["x"]), job(absolute_url={"a": 1}),
        job(title=[None]), job(location={"name": 5}), job(location={"name": ["x"]}), 5, None, "x",
        [], job(title=0.5),
    ]
    fine = [job(), job(title="", location={"name": 5})]
    rows = mapped({"jobs": [*bad, *fine]})
    assert by_pos(mapping.postings(rows), "title") == {len(bad): "T"}
    assert sorted(by_pos(mapping.rejects(rows), "reject")) == list(range(len(bad)))
    assert collect.isolate_sources(rows).count() == 0
    assert collect.isolate_sources(rows, collect.QUARANTINE).count() == 1


@pytest.fixture(params=["as one variant", "member by member"])
def reader(request, monkeypatch):
    """Both ways a body may be read; the second takes over for very large ones."""
    if request.param != "as one variant":
        monkeypatch.setattr(payloads, "parsed_body", lambda wrapped: F.lit(None).cast("variant"))


def test_bodies_without_jobs(mapped, reader):
    empty = ["{}", '{"jobs": []}', '{"jobs": {}}', '{"jobs": ""}', ' {"other": 1}\n']
    bad = [
        "", "nope", "[]", "null", "5", '"x"', '{"jobs": null}', '{"jobs": 3}', '{"jobs": "x"}',
        '{"jobs": {"a": 1}}', '{"jobs": false}', '{"jobs": []} x', '{"jobs": []}, {"jobs": []}',
        '{"jobs": [{"title": "a"}', "{'jobs': []}", '[{"jobs": []}]', '{"jobs": [NaN]}',
    ]
    rows = mapped(*empty, *bad, {"jobs": [job()]})
    last = len(empty) + len(bad)
    assert by_body(mapping.postings(rows)) == [last]
    assert by_body(mapping.rejects(rows)) == list(range(len(empty), last))


def test_both_readers_give_the_same_rows(spark, landed, monkeypatch):
    bodies = [
        {"jobs": [job(), 5, None, [1], job(title=3), job(location=["x"]), {}]}, {"jobs": []}, {"other": 1}, "[]",
        '{"jobs": null}', "nope", {"jobs": [{"title": "a 'b'", "absolute_url": "u", "content": {"description": "é"}}]},
    ]
    columns = ("landed_pos", "pos", "payload_reject")

    def rows():
        opened = job_rows(landed(*bodies))
        return sorted(map(str, opened.select(*columns, F.to_json("job").alias("job")).collect()))

    first = rows()
    monkeypatch.setattr(payloads, "parsed_body", lambda wrapped: F.lit(None).cast("variant"))
    assert rows() == first


@pytest.fixture
def no_variant(monkeypatch):
    """Bodies, and jobs with the word big in them, are too large for a variant."""
    monkeypatch.setattr(payloads, "parsed_body", lambda wrapped: F.lit(None).cast("variant"))
    real = F.try_parse_json
    too_large = lambda text: F.when(~F.contains(text, F.lit("big")), real(text))
    monkeypatch.setattr(payloads.F, "try_parse_json", too_large)
    monkeypatch.setattr(payloads, "SURE_TO_FIT", 10)
    # What the reader of whole bodies gives for one with such a job.
    monkeypatch.setattr(payloads, "body_variants", lambda wrapped: F.lit(None).cast("array<variant>"))


def test_no_job_is_rejected_for_its_size(spark, landed, mapped, no_variant):
    large = job(title=" big ", location={"name": "Rome"}, content={"description": "x", "requirements": 5, "responsibilities": "y"})
    body = {"jobs": [job(), large, job(title="big", absolute_url=7), job()]}
    rows = job_rows(landed(body)).select("pos", "payload_reject", F.col("job").isNull()).orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [(0, None, False), (1, None, True), (2, None, True), (3, None, False)]
    posts = mapping.postings(mapped(body)).orderBy("ingest_seq").collect()
    assert [p.title for p in posts] == [job()["title"], "big", job()["title"]]
    assert (posts[1].location, posts[1].description, posts[1].raw) == ("Rome", "x\n\ny", None)
    assert [r.reject for r in mapping.rejects(mapped(body)).collect()] == ["url is not text"]


def test_a_value_too_large_is_one_reject(spark, landed, no_variant, monkeypatch):
    body = landed({"jobs": [job(), {"title": "big"}, job()]})
    broken = lambda text: F.from_json(F.lit("{"), f"struct<{', '.join(f'{n}: variant' for n in payloads.JOB_MEMBERS)}, _corrupt: string>", payloads._STRICT_JSON)
    monkeypatch.setattr(payloads, "_member_by_member", broken)
    rows = job_rows(body).select("pos", "payload_reject").orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [(0, None), (1, payloads.TOO_LARGE), (2, None)]


def test_repeated_members_keep_the_last_value(mapped):
    body = '{"jobs": [], "jobs": [{"title": "a", "title": "b", "absolute_url": "u"}]}'
    assert one(mapping.postings(mapped(body))).title == "b"


def test_bodies_too_large_for_one_variant(spark, landed):
    size = 1200
    payload = F.concat(
        F.lit('{"jobs": ['),
        F.array_join(
            F.transform(
                F.sequence(F.lit(1), F.lit(size)),
                lambda n: F.concat(
                    F.lit('{"title": "t'), n.cast("string"), F.lit('", "absolute_url": "'),
                    F.repeat(F.lit("x"), 20000), F.lit('"}'),
                ),
            ),
            ",",
        ),
        F.lit("]}"),
    )
    jobs = job_rows(landed("{}").withColumn("payload", payload))
    title = F.try_variant_get("job", "$.title", "string")
    row = jobs.agg(F.count("*"), F.max("pos"), F.max("payload_reject"), F.count_distinct(title)).first()
    assert tuple(row) == (size, size - 1, None, size)


def test_boards_keep_order_and_repeats(spark, mapped):
    boards = (Board("acme", "first"), Board("other"), Board("acme", "second"))
    rows = mapping.postings(mapped({"jobs": [job(), job()]}, boards=boards))
    got = [(r.company, r.ingest_seq.board_ord, r.ingest_seq.pos) for r in rows.orderBy("ingest_seq").collect()]
    assert got == [("first", 0, 0), ("first", 0, 1), ("second", 2, 0), ("second", 2, 1)]
    assert mapped({"jobs": [job()]}, boards=()).count() == 0


def test_source_that_cannot_be_planned_is_left_out(spark, landed):
    def missing(session):
        return session.read.parquet("/nowhere/at/all")

    boards = (Board("acme"),)
    def raising(session):
        raise RuntimeError("no connection")

    sources = [
        collect.board_source(missing, boards, "broken"),
        collect.board_source(raising, boards, "raising"),
        collect.board_source(lambda _: landed({"jobs": [job()]}), boards, "sound"),
    ]
    rows = collect.load_sources(spark, sources).collect()
    assert [(r.source, r.ingest_seq.source_ord) for r in rows] == [("sound", 2)]
    assert collect.load_sources(spark, sources[:2]).count() == 0


def test_mapping_needs_no_shuffle_and_no_python(spark, landed):
    payloads = join_boards(landed({"jobs": []}), boards_frame(spark, (Board("acme"),)))
    rows = mapping.postings(mapping.map_jobs(with_ingest_seq(job_rows(payloads))))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BatchEval" not in plan and "hashpartitioning" not in plan
