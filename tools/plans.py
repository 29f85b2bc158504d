"""Print the formatted physical plan of catalogue queries.

    python tools/plans.py [sf_dir] name [name ...]

No job runs except the small size checks some operators make while the plan
is built (k-NN block sizing, counted broadcasts, written lineage cuts).
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from taxomatch.plans import catalog  # noqa: E402
from taxomatch.session import local_session  # noqa: E402


def main(argv):
    sf = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    spark = local_session(8)
    for name in names:
        print(f"===== {name}")
        catalog.QUERIES[name](spark, sf).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
