"""Print Spark's formatted physical plan for registered queries.

usage: python tools/show_plans.py [sf_dir] name [name ...]
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def main(argv):
    from tillroll.plans.catalog import QUERIES
    from tillroll.session import local_session

    sf_dir = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.1"
    names = [a for a in argv if not a.startswith("/")]
    spark = local_session(8, 16)
    for name in names:
        print(f"===== {name}")
        QUERIES[name](spark, sf_dir).explain("formatted")


if __name__ == "__main__":
    main(sys.argv[1:])
