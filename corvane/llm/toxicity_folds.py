"""Chooses the settings of ``toxicity`` by folds inside the rows that may be learnt from.

Rows whose crc32(doc_id) mod 5 is 0 are never read. The rest, near copies of one
label taken out, is dealt into ``FOLDS`` folds by a hash of the text; each
setting is fitted on all folds but one and judged on that one by its F1 at 0.5;
the best mean over tables of different sizes is taken.

    python -m corvane.llm.toxicity_folds DIR...
"""

from __future__ import annotations

import itertools
import sys
import zlib
from concurrent.futures import ProcessPoolExecutor

import numpy as np
import pyarrow.parquet as pq

from corvane.llm import toxicity

FOLDS = 4
TRIED = [toxicity.Setting(few, 4.0, decay, most, least) for few, decay, most, least in itertools.product((2, 4), (0.003, 0.01), (100, 150, 250), (0, 20, 40, 80))]


def rows(folder: str) -> tuple[list[str], list[int]]:
    """Texts and labels of the rows that may be learnt from, as many as ``toxicity.train`` takes."""
    marked: dict[int, int] = {}
    for r in pq.read_table(f"{folder}/labels.parquet", columns=["doc_id", "toxic"]).to_pylist():
        if r["doc_id"] is not None and r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            marked[r["doc_id"]] = max(marked.get(r["doc_id"], 0), int(r["toxic"] > 0))
    found = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    own = sorted(((zlib.crc32(b"sample%d" % r["doc_id"]), r["text"] or "", marked[r["doc_id"]]) for r in found if r["doc_id"] in marked))
    chosen = [r for label, most in toxicity.MAX_ROWS.items() for r in [x for x in own if x[2] == label][:most]]
    kept = toxicity.first_of_copies([t for _, t, _ in chosen], [x for _, _, x in chosen])
    return [chosen[i][1] for i in kept], [chosen[i][2] for i in kept]


def judged(texts: list[str], labels: list[int], setting: toxicity.Setting, fold: int) -> tuple[int, int, int]:
    """(toxic found, toxic missed, false alarms) in a fold."""
    of = [zlib.crc32(t.encode("utf-8", "replace")) % FOLDS for t in texts]
    inside = [i for i, x in enumerate(of) if x != fold]
    model = toxicity.fit([texts[i] for i in inside], [labels[i] for i in inside], setting)
    out = [i for i, x in enumerate(of) if x == fold]
    said = np.array(model.scorer().scores([texts[i] for i in out])) >= 0.5
    y = np.array([labels[i] for i in out]) == 1
    return int((said & y).sum()), int((~said & y).sum()), int((said & ~y).sum())


def main() -> None:
    for folder in sys.argv[1:]:
        texts, labels = rows(folder)
        print(folder, len(labels), sum(labels), flush=True)
        jobs = [(s, f) for s in TRIED for f in range(FOLDS)]
        with ProcessPoolExecutor(max_workers=8) as pool:
            found = list(pool.map(judged, [texts] * len(jobs), [labels] * len(jobs), [s for s, _ in jobs], [f for _, f in jobs]))
        for i, s in enumerate(TRIED):
            hit, missed, false = (sum(x[k] for x in found[FOLDS * i : FOLDS * (i + 1)]) for k in range(3))
            print(f"{s}: found {hit}, missed {missed}, false alarms {false}, F1 {2 * hit / (2 * hit + missed + false):.3f}", flush=True)


if __name__ == "__main__":
    main()
