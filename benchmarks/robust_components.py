"""How much the robust components leave for the rule on neighbours, and whether a spike escapes them.

python benchmarks/robust_components.py [SF_DIR]: for every component of every dataset the share of
readings that are candidates, and how many of the spikes are among them; beside it, how the sparse
part would do alone, were it compared with thresholds.
"""

from __future__ import annotations

import sys

import duckdb
import numpy as np

sys.path.insert(0, ".")
from frameledger.operators.spikes import PROFILE, candidates, low_rank, standoff  # noqa: E402


def main(sf: str) -> None:
    q = f"SELECT DISTINCT dataset_id, episode_index, frame_index, action FROM '{sf}/frames.parquet' WHERE action IS NOT NULL ORDER BY 1, 2, 3"
    t = duckdb.sql(q).fetchnumpy()
    alone = {k: [0, 0, 0] for k in (5, 10, 20)}
    readings = chosen = spikes = kept = 0
    for d in np.unique(t["dataset_id"]):
        use = t["dataset_id"] == d
        e, a = t["episode_index"][use], t["action"][use]
        for c in range(max(map(len, a))):
            x = np.array([np.nan if r[c] is None else r[c] for r in a], float)
            ok = np.isfinite(x)
            x, g = x[ok], e[ok]
            change = np.abs(np.diff(x))[g[1:] == g[:-1]]
            step = np.quantile(change[change > 0], 0.75)
            want = standoff(x, g) > 20 * step
            one = candidates(x, g, 20 * step)
            readings, chosen, spikes, kept = readings + len(x), chosen + len(one), spikes + int(want.sum()), kept + int(want[one].sum())
            whole = len(x) // PROFILE * PROFILE
            m = x[:whole].reshape(-1, PROFILE)
            off = np.abs(m - low_rank(m, 20 * step)).ravel()
            for k, n in alone.items():
                got = off > k * step
                n[0] += int((got & want[:whole]).sum())
                n[1] += int(got.sum())
                n[2] += int(want[:whole].sum())
    print(f"{chosen} of {readings} readings are candidates ({chosen / readings:.1%}); they hold {kept} of {spikes} spikes")
    for k, (both, got, want) in alone.items():
        print(f"residual beyond {k} steps alone: recall {both / want:.3f}, precision {both / max(got, 1):.3f}")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
