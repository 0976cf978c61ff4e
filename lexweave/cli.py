"""Command line: python -m lexweave.cli FILE.pdf --profile indian-statute [-o OUT]."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from lexweave.operators import export, lines, statute
from lexweave.session import local_session
from lexweave.shipping import ship
from lexweave.sources import files, pdf


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexweave", description="Statute PDF to JSON")
    parser.add_argument("path")
    parser.add_argument("--profile", choices=["indian-statute"], required=True)
    parser.add_argument("-o", "--output")
    asked = parser.parse_args(argv)
    spark = local_session()
    ship(spark)
    read = pdf.read_pdfs(files.accepted(files.read_binary(spark, asked.path))).cache()
    fault = read.select("fault").first()
    if fault is None or fault.fault:
        print(fault.fault if fault else "not a PDF file", file=sys.stderr)
        return 1
    parsed = statute.parse(lines.statute_lines(pdf.lines(read), pdf.pages(read)))
    row = export.statute_json(statute.metadata(parsed), export.nested(statute.provisions(parsed))).first()
    if row is None:
        print("no text", file=sys.stderr)
        return 1
    if asked.output:
        Path(asked.output).write_text(row.json, encoding="utf-8")
    else:
        print(row.json)
    return 0


if __name__ == "__main__":
    sys.exit(main())
