"""python -m tallyloom compare|compare-bidders|compare-package|compare-versions ... --out DIR: a comparison of workbooks, written as tables."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .config import read_settings
from .operators import flows, items, peer, quotes, requirements
from .operators.advisor import bidder_from_file
from .sources.workbook import read_workbooks


def load(spark: SparkSession, path: str, bid: bool, max_rows: int) -> DataFrame:
    cells = read_workbooks(spark, path, max_rows=max_rows)
    return items.load_items(cells, bid, max_rows).withColumn("bidder", bidder_from_file(F.col("workbook")))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tallyloom", description=__doc__)
    parser.add_argument("command", choices=("compare", "compare-bidders", "compare-package", "compare-versions"))
    parser.add_argument("--reference", help="workbook of the invitation, or of the older version")
    parser.add_argument("--bidders", required=True, help="folder or glob of offers, or the newer version")
    parser.add_argument("--requirements", help="workbook of required brands and origins")
    parser.add_argument("--out", required=True)
    args = parser.parse_args(argv)
    spark, settings = SparkSession.builder.getOrCreate(), read_settings()
    offers = flows.require_items(load(spark, args.bidders, True, settings.max_rows), args.bidders)
    if args.command == "compare-bidders":
        grid = flows.peer_catalogue(offers, settings)
        prices = grid.join(offers.select("item_id", "unit_price_total"), "item_id", "left")
        tables = {"catalogue": grid, "spread": peer.price_spread(prices, "canonical_id", "bidder", "unit_price_total")}
    elif args.command == "compare-versions":
        changes = flows.version_changes(load(spark, args.reference, True, settings.max_rows), offers, settings)
        tables = {"changes": changes, "totals": flows.version_totals(changes)}
    else:
        package = args.command == "compare-package"
        reference = load(spark, args.reference, False, settings.max_rows)
        if package:
            wanted = requirements.load_requirements(read_workbooks(spark, args.requirements))
            rows = flows.compare_package(reference, offers, wanted, settings)
        else:
            rows = flows.compare_tender(reference, offers, False, settings)
        rows = rows.checkpoint()
        tables = {"rows": flows.flat_rows(rows), "differences": flows.difference_rows(rows), "anomalies": flows.flat_rows(flows.anomalies(rows)), "unmatched": flows.unmatched(rows), "summary": flows.summary(rows, reference), "marks": quotes.marks(rows), "roll_up": quotes.roll_up_rows(rows), "quality": flows.quality_rows(offers)}
    written = sinks.write_report(tables, args.out)
    sinks.write_manifest(offers, f"{args.out}/manifest", command=args.command, tables=written, settings=settings)


if __name__ == "__main__":
    main()
