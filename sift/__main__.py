"""Submit one run over landed payloads.

    spark-submit ... sift/__main__.py --config rules.json \\
        --landing /feed --state /seen --alerts /alerts [--stream] [--compact]

The configuration is a JSON file, or YAML where a YAML reader is installed, with
the sections ``Settings.from_mapping`` reads. A run by hand takes in all of the landing
folder, so name the folder of one snapshot; it takes the next batch id, or
``--batch-id`` to try one again. ``--stream`` takes everything that landed since the
last time as one batch, and stops.
"""

from __future__ import annotations

import argparse
import json
import pathlib
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from sift.params import Settings
from sift.plans.batch import count_lines, keyword_scorer, run_feed, text_sink
from sift.session import configure
from sift.sources.collect import DROP_SOURCE, QUARANTINE, board_source, load_sources
from sift.sources.payloads import read_payload_files, read_payload_lines
from sift.state.seen import SeenStore
from sift.streaming.feed import start_feed


def read_settings(path: str) -> Settings:
    text = pathlib.Path(path).read_text(encoding="utf-8")
    if path.endswith((".yml", ".yaml")):
        try:
            import yaml
        except ImportError as error:
            raise SystemExit("no YAML reader is installed; give a JSON file") from error
        return Settings.from_mapping(yaml.safe_load(text))
    return Settings.from_mapping(json.loads(text))


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sift", description=__doc__.splitlines()[0])
    for name in ("config", "landing", "state", "alerts"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--stream", action="store_true")
    parser.add_argument("--checkpoint", help="defaults to a folder under spark.checkpoint.dir")
    parser.add_argument("--compact", action="store_true", help="merge the state before the run")
    parser.add_argument("--expire", action="store_true", help="delete what merged state has taken in")
    parser.add_argument("--buckets", type=int, default=256, help="buckets of merged state")
    parser.add_argument("--batch-id", type=int, help="run this batch again")
    parser.add_argument("--lines", action="store_true", help="one body a line instead of one a file")
    parser.add_argument("--on-bad", choices=(DROP_SOURCE, QUARANTINE), default=DROP_SOURCE)
    args = parser.parse_args(arguments)

    settings = read_settings(args.config)
    spark = configure(spark or SparkSession.builder.appName("sift").getOrCreate())
    store = SeenStore(spark, args.state, args.buckets)
    scorer, limits = keyword_scorer(settings.rules), settings.thresholds
    sink = text_sink(args.alerts, limits)
    before = store.next_batch_id() if args.batch_id is None else args.batch_id
    if args.compact and before > 0:
        store.compact(before - 1)
    if args.expire and before > 0:
        store.expire(before - 1)
    if args.stream:
        start_feed(
            spark, args.landing, settings.boards, scorer, store, limits, sink,
            checkpoint=args.checkpoint, on_bad=args.on_bad,
        ).awaitTermination()
        return
    read = read_payload_lines if args.lines else read_payload_files
    feed = board_source(lambda s: read(s, args.landing, settings.boards), settings.boards)
    mapped, now = load_sources(spark, [feed]), datetime.now(timezone.utc)
    batch = store.begin(args.batch_id)
    run_feed(mapped, scorer, store, batch, now, limits, sink, args.on_bad, [feed.name])
    print("\n".join(count_lines(batch.counts)))


if __name__ == "__main__":
    main()
