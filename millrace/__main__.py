"""python -m millrace ROOT [DATA]: a shell. A statement ends with an empty line."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .session import Session


def main(args: list[str]) -> None:
    if not args:
        sys.exit(__doc__)
    session = Session(SparkSession.builder.getOrCreate(), args[0], args[1] if len(args) > 1 else ".")
    lines: list[str] = []
    print("> ", end="", flush=True)
    for line in sys.stdin:
        if line.strip():
            lines.append(line)
            continue
        if lines:
            session.run("".join(lines))
            lines = []
        if session.over:
            return
        print("> ", end="", flush=True)
    if lines:
        session.run("".join(lines))


if __name__ == "__main__":
    main(sys.argv[1:])
