"""Command line of the knowledge base: python -m lorewright.cli --root PATH COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from lorewright.api import KnowledgeBase
from lorewright.errors import LoreError
from lorewright.govern import autonomous, watch


def _rows(df: DataFrame) -> list[dict]:
    """All rows; they stream through the driver a partition at a time."""
    return [r.asDict(recursive=True) for r in df.toLocalIterator()]


#: command: its arguments, and what it does.
COMMANDS = {
    "ingest": (("kind", "payload"), lambda kb, a: kb.ingest(a.kind, json.loads(a.payload))), "get": (("id",), lambda kb, a: {k: v for k, v in kb.get(a.id).items() if k != "body"}), "update": (("id", "payload"), lambda kb, a: kb.update(a.id, json.loads(a.payload))),
    "touch": (("id",), lambda kb, a: kb.touch(a.id)), "link": (("source", "target", "type"), lambda kb, a: kb.link(a.source, a.target, a.type)), "unlink": (("source", "target"), lambda kb, a: kb.unlink(a.source, a.target)),
    "promote": (("id", "kind"), lambda kb, a: kb.promote(a.id, a.kind)), "rename": (("id", "slug"), lambda kb, a: kb.rename(a.id, a.slug)), "domains": ((), lambda kb, a: _rows(kb.domains())), "search": (("query",), lambda kb, a: _rows(kb.search(a.query))),
    "related": (("id",), lambda kb, a: _rows(kb.related(a.id))), "build-registry": ((), lambda kb, a: _rows(kb.build())), "recompute": ((), lambda kb, a: kb.recompute()), "rebuild-dense-index": ((), lambda kb, a: _rows(kb.rebuild_dense())), "watch": (("target",), lambda kb, a: watch.watch(kb, a.target)), "doctor": ((), lambda kb, a: _rows(kb.doctor())), "diagnose": ((), lambda kb, a: _rows(kb.diagnose())),
    "stats": (("by",), lambda kb, a: _rows(kb.stats(a.by))), "review": ((), lambda kb, a: _rows(kb.review())), "queue": ((), lambda kb, a: _rows(kb.queue())), "approve": (("id",), lambda kb, a: autonomous.approve(kb, a.id)), "reject": (("id",), lambda kb, a: autonomous.reject(kb, a.id)),
}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lorewright")
    parser.add_argument("--root", required=True)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (arguments, _) in COMMANDS.items():
        command = commands.add_parser(name)
        for argument in arguments:
            command.add_argument(argument)
    asked = parser.parse_args(args)
    kb = KnowledgeBase(spark or SparkSession.builder.appName("lorewright").getOrCreate(), asked.root)
    try:
        print(json.dumps(COMMANDS[asked.command][1](kb, asked), default=str, ensure_ascii=False))
    except LoreError as e:
        print(json.dumps({"code": e.code, "message": str(e)}), file=sys.stderr)
        return e.exit_status
    return 0


if __name__ == "__main__":
    sys.exit(main())
