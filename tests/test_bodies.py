"""Bodies that several tasks read: cut anywhere, the jobs and rejects of a body read whole."""

from __future__ import annotations

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_runs import RULES, clock, store  # noqa: F401

from sift.operators import mapping
from sift.params import Board
from sift.plans.batch import keyword_scorer, run_feed
from sift.sources import bodies
from sift.sources.bodies import Cutter, Sum, read_split_bodies
from sift.sources.collect import board_source
from sift.sources.payloads import job_rows, read_payload_files

BOARDS = (Board("one"), Board("two"))
TEXTS = ["", "a", "}", "{", "]", "[", ",", '"', "\\", '\\"', "jobs", '"jobs":[', "é", "中", "😀", "\n", "},{", '"}', "\\\\", "x" * 90]


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rng.choice([None, True, 0, -1.5, 12345])
    if kind < 4:
        return "".join(rng.choices(TEXTS, k=rng.randrange(5)))
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    names = ["jobs", "a", "title", "}", 'q"', "absolute_url"]
    return {rng.choice(names): value(rng, depth + 1) for _ in range(rng.randrange(4))}


def body(rng):
    """A body with other members around its jobs, written in one of several styles."""
    jobs = [{"title": value(rng, 2), "absolute_url": f"u{rng.randrange(9)}", "content": value(rng)} for _ in range(rng.randrange(7))]
    jobs += [value(rng, 2) for _ in range(rng.randrange(2))]
    rng.shuffle(jobs)
    before = {f"k{n}": value(rng, 1) for n in range(rng.randrange(3))}
    after = {f"l{n}": value(rng, 1) for n in range(rng.randrange(3))}
    style = rng.choice([{"indent": 1}, {"separators": (",", ":")}, {}, {"ensure_ascii": False}])
    return rng.choice(["", " ", "\n"]) + json.dumps({**before, "jobs": jobs, **after}, **style) + rng.choice(["", "\n", " \n "])


BROKEN = [
    "", " ", "nope", "[]", "null", '{"jobs": null}', '{"jobs": 3}', '{"jobs": {"a": 1}}', "{}", '{"jobs": []}', '{"jobs": [ \n ]}', '{"jobs": ""}', '{"other": [1, 2]}',
    '{"jobs": []} x', '{"jobs": []}, {"jobs": []}', '{"jobs": [{"title": "a"}', '{"jobs": [{"title": "a"}]', "{'jobs': []}", '[{"jobs": [{}]}]', '{"jobs": [{},]}', '{"jobs": [,{}]}',
    '{"jobs": [NaN]}', '{"jobs": [{} {}]}', '{"jobs": [{"title": "a}]}', '{"a": {"jobs": [{}]}}', '{"jobs": [{"title": "a", "absolute_url": "u"}', '{"jobs"\n:\t[{"title": "a"}]}', '}', ']', '{"jobs": [}', '"jobs":[{}]',
]


# ---- cutting ------------------------------------------------------------------


def folded(sums):
    """The states of ranges, by their definition and without Spark."""
    inside, depth, listed, states = 0, 0, False, []
    for own in sums:
        states.append((inside, depth, listed))
        if depth + own.lowest[inside] < 2:
            listed = any(depth + d == 1 for d in own.open[inside])
        inside, depth = inside ^ own.parity, depth + own.delta[inside]
    return states


def cut(text, rng):
    """Jobs of a text whose records are dealt to ranges and slices at random."""
    raw = text.encode()
    records = [r + b"}" for r in raw.split(b"}")]
    records[-1] = records[-1][:-1]
    ranges, own = [], []
    for record in records:
        own.append(record)
        if rng.random() < 0.4:
            ranges.append(own)
            own = []
    ranges.append(own)
    sums = []
    for own in ranges:
        sums.append(Sum())
        for record in own:
            sums[-1].add(record)
    jobs, rest, held = [], b"", None
    for own, state in zip(ranges, folded(sums)):
        cutter, parts = Cutter(*state), []
        for record in own:
            parts += cutter.add(record)
        for kind, piece, begins, ends in [*parts, *cutter.end()]:
            if kind == bodies.REST:
                rest += piece
            elif kind == bodies.WHOLE:
                jobs.append((piece, begins, ends))
            else:
                held = (piece, begins, ends) if kind == bodies.TAIL else (held[0] + piece, held[1], ends)
                if kind == bodies.HEAD:
                    jobs.append(held)
    return [j for j, begins, ends in jobs if not (begins and ends and not j.strip())], rest


@pytest.mark.parametrize("seed", range(40))
def test_cuts_anywhere_give_the_same_jobs(seed):
    rng = random.Random(seed)
    text = body(rng)
    whole = json.loads(text)
    jobs, rest = cut(text, rng)
    assert [json.loads(j) for j in jobs] == whole["jobs"]
    assert json.loads(rest) == {**whole, "jobs": []}


# ---- reading ------------------------------------------------------------------


@pytest.fixture
def small_ranges(spark):
    """Ranges of some hundred bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "400", "spark.sql.files.openCostInBytes": "400", "spark.sql.files.minPartitionNum": "8"}
    for name, size in names.items():
        spark.conf.set(name, size)
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.fixture
def landing(tmp_path):
    def land(texts):
        for n, text in enumerate(texts):
            folder = tmp_path / "landing" / f"board={'two' if n % 3 else 'one'}"
            folder.mkdir(parents=True, exist_ok=True)
            (folder / f"{n:04}.json").write_bytes(text.encode())
        return str(tmp_path / "landing")

    return land


def found(rows):
    """Jobs of each file in order, and the rejects of each file."""
    own = job_rows(rows).select("token", "landed", "landed_pos", "pos", "payload_reject", F.to_json("job").alias("job")).collect()
    own.sort(key=lambda r: (r.landed, r.landed_pos, -1 if r.pos is None else r.pos))
    jobs = [(r.token, r.landed, r.job) for r in own if r.pos is not None]
    return jobs, {(r.token, r.landed) for r in own if r.payload_reject is not None}, Counter(r.landed for r in own if r.pos is not None)


@pytest.mark.parametrize("portion", [500_000, 30])
def test_split_bodies_are_the_whole_ones(spark, landing, small_ranges, monkeypatch, portion):
    monkeypatch.setattr(bodies, "MAX_RANGES", portion)
    rng = random.Random(7)
    path = landing([body(rng) for _ in range(30)])
    split = read_split_bodies(spark, path, BOARDS)
    jobs, rejects, counts = found(split)
    assert (jobs, rejects) == found(read_payload_files(spark, path, BOARDS))[:2]
    assert len(jobs) > 50 and not rejects and max(counts.values()) > 4
    assert split.where("landed_pos = -1").count() == 30
    assert {r.token for r in read_split_bodies(spark, path, BOARDS[:1]).collect()} == {"one"}


def test_broken_bodies_are_rejected_as_when_read_whole(spark, landing, small_ranges):
    path = landing(BROKEN)
    whole, split = found(read_payload_files(spark, path)), found(read_split_bodies(spark, path))
    assert split[1] == whole[1]
    # Sound bodies give what they gave; a broken one may give the jobs that are sound.
    bad = {landed for _, landed in whole[1]}
    assert [j for j in split[0] if j[1] not in bad] == [j for j in whole[0] if j[1] not in bad]


def test_a_feed_of_split_bodies(spark, landing, small_ranges, store):  # noqa: F811
    titles = ["Data Analyst } sql", "cook", 'Data Analyst "x"', "Data Analyst } sql"]
    jobs = [{"title": t, "absolute_url": f"u/{t}", "content": {"description": "d" * 400}} for t in titles]
    path = landing([json.dumps({"jobs": jobs}), json.dumps({"jobs": jobs[:2]})])
    feed = board_source(lambda s: read_split_bodies(s, path, BOARDS), BOARDS).load(spark, 0)
    whole = board_source(lambda s: read_payload_files(s, path, BOARDS), BOARDS).load(spark, 0)
    columns = ["title", "company", "url", "description"]
    assert sorted(mapping.postings(feed).select(columns).collect()) == sorted(mapping.postings(whole).select(columns).collect())
    chosen = run_feed(feed, keyword_scorer(RULES), store, None, clock(0))
    assert sorted((r.title, r.company) for r in chosen.collect()) == [('Data Analyst "x"', "one"), ("Data Analyst } sql", "one"), ("Data Analyst } sql", "two")]


def test_one_body_is_read_by_many_tasks(spark, tmp_path):
    """Twenty megabytes in ranges of one: every task gives its own jobs, two pieces a range move."""
    folder = tmp_path / "landing" / "board=one"
    folder.mkdir(parents=True)
    jobs = [{"title": f"t{n} }}{{", "absolute_url": f"u{n}", "content": {"description": "word, " * 100}} for n in range(30_000)]
    (folder / "a.json").write_text(json.dumps({"jobs": jobs}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    spark.conf.set("spark.sql.files.openCostInBytes", "1m")
    try:
        rows = read_split_bodies(spark, str(tmp_path / "landing"))
        own = rows.select(F.spark_partition_id().alias("p"), "landed_pos", "payload")
        per_task = own.where("landed_pos >= 0").groupBy("p").count().collect()
        assert sum(r["count"] for r in per_task) == 30_000 and len([r for r in per_task if r["count"] > 1000]) >= 18
        title = F.get_json_object("payload", "$.jobs[0].title")
        assert [r.t for r in rows.where("landed_pos >= 0").orderBy("landed_pos").select(title.alias("t")).collect()] == [j["title"] for j in jobs]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
