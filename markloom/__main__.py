"""python -m markloom FILE, or - for the standard input: HTML of one document."""

from __future__ import annotations

import sys
from pathlib import Path

from .api import to_html


def main(args: list[str]) -> int:
    if len(args) != 1:
        print(__doc__, file=sys.stderr)
        return 2
    source = sys.stdin.buffer.read() if args[0] == "-" else Path(args[0]).read_bytes()
    sys.stdout.buffer.write(to_html(source.decode("utf-8", "replace")).encode())
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
