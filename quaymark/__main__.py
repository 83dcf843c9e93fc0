"""python -m quaymark FOLDER metrics | coverage | query DATASET METRIC [name=value ...] | retrieve [name=value ...]"""

from __future__ import annotations

import json
import sys

from quaymark import session
from quaymark.api import TYPES, Engine


def _typed(name: str, text: str) -> object:
    """An argument of the command line by its type; lists stay texts with commas."""
    kind = TYPES.get(name)
    if kind == "integer":
        return int(text)
    return text.strip().lower() in ("true", "yes", "1") if kind == "boolean" else text


def main(args: list[str]) -> int:
    if len(args) < 2 or args[1] not in ("metrics", "coverage", "query", "retrieve") or (args[1] == "query" and len(args) < 4):
        print(__doc__, file=sys.stderr)
        return 2
    engine = Engine(session.build("quaymark-cli"), args[0])
    given = {k: _typed(k, v) for k, v in (a.split("=", 1) for a in args[2:] if "=" in a)}
    if args[1] == "metrics":
        found, ok = {"metrics": engine.schemas()}, True
    elif args[1] == "query":
        found, ok = engine.execute("query_data", {"dataset": args[2], "metric": args[3], **given})
    else:
        found, ok = engine.execute(args[1], given)
    print(json.dumps(found, ensure_ascii=False, indent=1))
    return 0 if ok else 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
