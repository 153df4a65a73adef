"""python -m tracefold run CONFIG [--seed N] | repeat CONFIG --seeds A B ... | report RESULTS OUT | map GRAPHML FOLDER --region R [--box W S E N]"""

from __future__ import annotations

import argparse
from dataclasses import replace

from .plans import config, experiment, report
from .session import get_spark
from .sources import trajectories


def main() -> None:
    parser = argparse.ArgumentParser(prog="tracefold")
    sub = parser.add_subparsers(dest="what", required=True)
    run = sub.add_parser("run")
    run.add_argument("config")
    run.add_argument("--seed", type=int)
    repeat = sub.add_parser("repeat")
    repeat.add_argument("config")
    repeat.add_argument("--seeds", type=int, nargs="+", required=True)
    page = sub.add_parser("report")
    page.add_argument("results")
    page.add_argument("out")
    made = sub.add_parser("map")
    made.add_argument("graphml")
    made.add_argument("folder")
    made.add_argument("--region", nargs="+", required=True)
    made.add_argument("--box", type=float, nargs="+", help="four numbers a region")
    args = parser.parse_args()
    if args.what == "map":
        boxes = args.box or []
        if boxes and len(boxes) != 4 * len(args.region):
            parser.error("a box has four numbers for each region")
        for k, region in enumerate(args.region):
            print(trajectories.build_network(get_spark(), args.graphml, f"{args.folder}/{region}", region, tuple(boxes[4 * k : 4 * k + 4]) or None))
        return
    if args.what == "report":
        print(report.generate(get_spark(), args.results, args.out))
        return
    cfg = config.load(args.config)
    if args.what == "repeat":
        experiment.repeat(get_spark(), cfg, args.seeds).orderBy("result_id", "metric").show(1000, False)
        return
    if args.seed is not None:
        cfg = replace(cfg, seed=args.seed, output_dir=f"{cfg.output_dir}/seed{args.seed}")
    experiment.run(get_spark(), cfg).select("result_id", "metric", "value", "ci_low", "ci_high").orderBy("result_id", "metric").show(1000, False)


if __name__ == "__main__":
    main()
