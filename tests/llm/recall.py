"""Recall of planted links by the sorted passes, replayed without Spark: python -m tests.llm.recall [ROWS] [COMMON ...].

ROWS vectors lie at cosine COMMON to each other; to 400 of them a partner at cosine 0.95 to 0.96 is added. Prints the share of
planted pairs that the passes link."""

import math
import sys
import time

import numpy as np
from lorewright.llm import embedding_dedup as e


def table(rows: int, common: float, planted: int = 400, dim: int = 64, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    middle = unit(rng.standard_normal(dim))
    x = rng.standard_normal((rows, dim))
    x = unit(math.sqrt(common) * middle + math.sqrt(1 - common) * unit(x - (x @ middle)[:, None] * middle))
    side = rng.standard_normal((planted, dim))
    side = unit(side - (side * x[:planted]).sum(axis=1, keepdims=True) * x[:planted])
    cos = rng.uniform(0.951, 0.96, (planted, 1))
    return np.concatenate([x, cos * x[:planted] + np.sqrt(1 - cos**2) * side])


def found(x: np.ndarray, threshold: float = 0.95, window: int = e.WINDOW, task_values: int = e.TASK_VALUES) -> set[tuple[int, int]]:
    """The pairs that the passes link, as the operator deals and sorts them."""
    ids, mean = np.arange(len(x)), x.mean(axis=0)
    tasks = max(1, -(-x.size // task_values))
    pairs: set[tuple[int, int]] = set()
    for p in range(e.passes_for(tasks, threshold, float(mean @ mean))):
        order = np.argsort(e._signs(x - mean, [p, x.shape[1]]), kind="stable")
        for part in np.array_split(order, tasks):
            pairs |= {(min(a, b), max(a, b)) for a, b in e.range_links(ids[part], x[part], threshold, window, [p, x.shape[1]])}
    return pairs


def recall(x: np.ndarray, planted: int = 400, **kw) -> float:
    pairs, n = found(x, **kw), len(x) - planted
    return sum((i, n + i) in pairs for i in range(planted)) / planted


if __name__ == "__main__":
    rows = int(sys.argv[1]) if len(sys.argv) > 1 else 100_000
    for common in [float(c) for c in sys.argv[2:]] or [0.0, 0.5, 0.8]:
        began = time.time()
        print(rows, common, recall(table(rows, common)), f"{time.time() - began:.0f} s", flush=True)
