"""python -m larkspur query ROOT TEXT | shell ROOT | version | help"""

from __future__ import annotations

import json
import sys

VERSION = "0.1.0"


def _shown(result) -> str:
    from larkspur.engine import Documents

    if isinstance(result, Documents):
        plain = lambda v: v.hex() if isinstance(v, (bytes, bytearray)) else str(v)
        return "\n".join(json.dumps(r, ensure_ascii=False, default=plain) for r in result.rows())
    return str(result)


def main(args: list[str]) -> int:
    if args[:1] == ["version"]:
        print(VERSION)
        return 0
    if len(args) < 2 or args[0] not in ("query", "shell") or (args[0] == "query") != (len(args) == 3):
        print(__doc__)
        return 0 if args[:1] == ["help"] else 2
    from pyspark.sql import SparkSession

    from larkspur.engine import Engine
    from larkspur.errors import EngineError

    engine = Engine(SparkSession.builder.appName("larkspur").getOrCreate(), args[1])
    lines = [args[2]] if args[0] == "query" else iter(lambda: sys.stdin.readline(), "")
    code = 0
    for line in lines:
        if line.strip() in ("exit", "quit"):
            break
        if line.strip():
            try:
                print(_shown(engine.execute(line)))
            except EngineError as e:
                print(e, file=sys.stderr)
                code = e.code
    return code if args[0] == "query" else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
