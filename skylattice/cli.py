"""Command line: model files to a cube."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from .functions.text import split_list


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skylattice", description="Convert model history files to a chunked cube.")
    p.add_argument("paths", nargs="+", help="input files, then the output path")
    p.add_argument("-v", "--variables", help="names, separated by commas")
    p.add_argument("-s", "--start-date")
    p.add_argument("-e", "--end-date")
    p.add_argument("-b", "--bbox", help="min lon, min lat, max lon, max lat")
    p.add_argument("-l", "--target-levels", help="metres, separated by commas")
    p.add_argument("--max-mem", type=int, default=2**27, help="bytes of a read partition")
    p.add_argument("-c", "--chunk-shape", help="time, height, y, x")
    p.add_argument("--compression", default="zstd", choices=["zstd", "lz4", "snappy", "gzip", "none"])
    p.add_argument("--above-ground", action="store_true")
    return p


def main(argv: Sequence[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    paths = args.paths[1:] if args.paths[0] == "wrf" else args.paths
    if len(paths) < 2:
        parser().error("needs input files and an output path")
    from .plans import convert
    from .session import session
    from .sources.model import ModelSource

    spark = spark or session()
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(args.max_mem))
    convert.write(
        ModelSource(spark, paths[:-1]), paths[-1], split_list(args.variables), args.start_date, args.end_date,
        split_list(args.bbox, float), split_list(args.target_levels, float), args.above_ground,
        split_list(args.chunk_shape, int), compression=args.compression,
    )
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
