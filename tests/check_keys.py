"""Compare registered queries with their SQL: check_keys.py SF_DIR [key or prefix ...]."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry_module  # noqa: E402
from provena import session  # noqa: E402
from tests import harness  # noqa: E402


def main() -> int:
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = session.build("local[8]")
    con = harness.connect(sf_dir)
    queries, oracle = entry_module.queries(), entry_module.oracle_sql()
    bad = 0
    for key, run in queries.items():
        if wanted and not any(key == w or (w.endswith("*") and key.startswith(w[:-1])) for w in wanted):
            continue
        began = time.time()
        try:
            df = run(spark, sf_dir)
            if key in oracle:
                note = harness.difference(df, con, oracle[key])
                rows = len(con.execute(oracle[key]).fetchall())
            else:
                rows, note = len(df.collect()), None
        except Exception as exc:  # noqa: BLE001
            note, rows = f"{type(exc).__name__}: {str(exc)[:500]}", -1
            if "-v" in wanted:
                traceback.print_exc()
        status = "OK " if note is None else "BAD"
        bad += note is not None
        print(f"{status} {key:28s} rows={rows:<7d} {time.time() - began:6.2f}s {'' if key in oracle else '(rows only)'} {note or ''}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
