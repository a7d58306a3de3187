"""Formats one text on the command line, without Spark: python -m inkstone.cli --input FILE."""

from __future__ import annotations

import argparse
import sys

from inkstone.functions import registry
from inkstone.functions.pipeline import format_text


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="inkstone")
    p.add_argument("--stdin", action="store_true", help="read the text from standard input; this wins over --input")
    p.add_argument("--input")
    p.add_argument("--output")
    p.add_argument("--rules", help="all, defaults, none, a preset, or keys with commas between")
    p.add_argument("--enable", action="append", default=[])
    p.add_argument("--disable", action="append", default=[])
    a = p.parse_args(argv)
    keys = lambda xs: [k for x in xs for k in x.split(",") if k]
    base = a.rules or "defaults"
    base = registry.PRESETS[base].rules() if base in registry.PRESETS else base if base in ("all", "defaults", "none") else keys([base])
    for k in [*([] if isinstance(base, str) else base), *keys(a.enable), *keys(a.disable)]:
        if k not in registry.BY_KEY:
            print(f"unknown rule {k}", file=sys.stderr)
    try:
        if a.stdin:
            text = sys.stdin.buffer.read().decode()
        elif a.input:
            with open(a.input, "rb") as f:
                text = f.read().decode()
        else:
            text = ""
        out = format_text(text, registry.Request(tuple(registry.adjust(base, keys(a.enable), keys(a.disable)))))
        if a.output:
            with open(a.output, "wb") as f:
                f.write(out.encode())
        else:
            sys.stdout.write(out if out.endswith("\n") else out + "\n")
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
