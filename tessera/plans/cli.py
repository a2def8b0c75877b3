"""Command line: python -m tessera.plans.cli --images DIR --labels DIR."""

from __future__ import annotations

import argparse
import ast
import sys

from tessera.operators.extract import BATCH, extractor
from tessera.plans.evaluate import evaluate_splits
from tessera.session import build_session, ship_package

#: What embeds crops where neither a table nor an extractor is given.
STAND_IN = "tessera.operators.extract:plain"


def option(text: str) -> tuple[str, object]:
    name, _, value = text.partition("=")
    return name, ast.literal_eval(value)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Quality scores of object-detection dataset splits")
    p.add_argument("--images", required=True, nargs="+", help="a folder of images for each split")
    p.add_argument("--labels", required=True, nargs="+", help="a folder of label files for each split, in the same order")
    p.add_argument("--names", nargs="+", help="a name for each split")
    p.add_argument("--embeddings", help="Parquet table dataset_id, image_id, box_id, emb")
    p.add_argument("--extractor", help="module:function from (n, 3, 224, 224) normalised RGB crops to n vectors")
    p.add_argument("--embed-batch", type=int, default=BATCH, help="crops that the extractor gets at once")
    p.add_argument("--strict", action="store_true", help="stop at images or labels that can't be read")
    p.add_argument("--reports", action="store_true", help="print every metric of each family as well")
    p.add_argument("--set", dest="options", type=option, action="append", default=[], metavar="NAME=VALUE", help="a feature's parameter, as ssi_radius=60; may be given again")
    a = p.parse_args(args)
    names = a.names or (["dataset"] if len(a.images) == 1 else a.images)
    if not len(names) == len(set(names)) == len(a.images) == len(a.labels):
        p.error("as many folders of images as of labels, and a name of its own for each")
    spark = build_session("tessera-cli")
    ship_package(spark)
    table = spark.read.parquet(a.embeddings) if a.embeddings else None
    if not a.embeddings and not a.extractor:
        print(f"no --embeddings and no --extractor: crops are embedded by {STAND_IN}, no network", file=sys.stderr)
    embed = None if a.embeddings else extractor(a.extractor or STAND_IN, a.embed_batch)
    splits = {n: (i, l) for n, i, l in zip(names, a.images, a.labels, strict=True)}
    scores, report = evaluate_splits(spark, splits, table, embed, "strict" if a.strict else "permissive", reports=a.reports, **dict(a.options))
    for r in sorted(report):
        print(f"{r['dataset_id']} {r['family']} {r['metric']}: {r['value']}")
    for split, row in scores.items():
        for name, value in row.items():
            print(f"{split + ' ' if len(splits) > 1 else ''}{name}: {value:.6f}")


if __name__ == "__main__":
    main()
