from __future__ import annotations

import json

import pytest

from sift.__main__ import main
from sift.state.seen import SeenStore


@pytest.mark.parametrize("mode", [[], ["--stream"]])
def test_two_runs_alert_once(spark, tmp_path, capsys, mode):
    folder = tmp_path / "landing" / "board=acme+co"
    folder.mkdir(parents=True)
    jobs = [{"title": "Data Analyst, SQL", "absolute_url": "u", "location": "Rome"}]
    (folder / "a.json").write_text(json.dumps({"jobs": jobs}))
    config = {
        "sources": {"greenhouse": {"boards": ["acme+co"]}},
        "scoring": {"include": {"roles": ["data analyst"]}},
    }
    (tmp_path / "c.json").write_text(json.dumps(config))
    where = [f"--{n}={tmp_path / n}" for n in ("landing", "state", "alerts", "checkpoint")]
    for extra in ([], ["--compact"]):
        main([f"--config={tmp_path / 'c.json'}", *where, *mode, *extra], spark)
    alerts = [p.read_text() for p in tmp_path.glob("alerts/batch_id=*/section=1/part-*")]
    assert "".join(alerts).count("[ 90] Data Analyst, SQL") == 1
    (row,) = SeenStore(spark, str(tmp_path / "state")).state().collect()
    assert (row.company, row.score, row.notified) == ("acme+co", 90, True)
    if not mode:
        assert capsys.readouterr().out == "greenhouse: 1 posts\n" * 2


def test_a_batch_can_be_run_again_by_its_number(spark, tmp_path, capsys):
    folder = tmp_path / "landing" / "board=acme"
    folder.mkdir(parents=True)
    (folder / "a.jsonl").write_text(json.dumps({"jobs": [{"title": "Analyst", "absolute_url": "u"}]}) + "\n")
    (tmp_path / "c.json").write_text(json.dumps({"sources": {"greenhouse": {"boards": ["acme"]}}}))
    where = [f"--{n}={tmp_path / n}" for n in ("landing", "state", "alerts")]
    for extra in (["--batch-id=0"], ["--batch-id=0"], ["--compact", "--expire", "--buckets=3"]):
        main([f"--config={tmp_path / 'c.json'}", *where, "--lines", *extra], spark)
    store = SeenStore(spark, str(tmp_path / "state"))
    assert store.state().count() == 1 and store.next_batch_id() == 2
    assert capsys.readouterr().out == "greenhouse: 1 posts\n" * 3
