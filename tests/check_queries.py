"""Run registered queries against their SQL: python tests/check_queries.py [sf_dir] [name prefix ...]"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, duck  # noqa: E402

from seslog.plans import load_queries  # noqa: E402
from seslog.session import local_session  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    queries, oracles = load_queries()
    spark = local_session(8)
    con = duck(sf_dir)
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                rows, message = compare(spark, con, fn, oracles[name], sf_dir)
                label = "sql"
            else:
                rows, message = fn(spark, sf_dir).count(), ""
                label = "rows"
        except Exception as error:  # noqa: BLE001 - a broken query must not hide the others
            if os.environ.get("TRACE"):
                traceback.print_exc()
            rows, message, label = -1, f"{type(error).__name__}: {str(error)[:1500]}", "error"
        bad += bool(message)
        print(f"{'FAIL' if message else 'ok  '} {name} [{label}] rows={rows} {time.time() - start:.1f}s {message}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
