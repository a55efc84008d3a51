"""python -m lorespark list | run QUERY [DIR] [--rows N] | explain QUERY [DIR] | plan TEXT"""

from __future__ import annotations

import argparse

from lorespark.plans import registry
from lorespark.plans.planner import plan
from lorespark.session import local_session


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lorespark", description=__doc__)
    p.add_argument("what", choices=["list", "run", "explain", "plan"])
    p.add_argument("name", nargs="?", default="")
    p.add_argument("dir", nargs="?", default="/root/testdata/sf0.001")
    p.add_argument("--rows", type=int, default=20)
    a = p.parse_args(args)
    if a.what == "list":
        print("\n".join(sorted(registry.queries())))
    elif a.what == "plan":
        print(plan(local_session(), a.name))
    else:
        df = registry.queries()[a.name](local_session(), a.dir)
        df.show(a.rows, truncate=80) if a.what == "run" else df.explain("formatted")


if __name__ == "__main__":
    main()
