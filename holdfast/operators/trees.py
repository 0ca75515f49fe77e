"""Decision trees as values: splits, and the paths to their leaves."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

Path = dict[int, tuple[float, float, float]]


@dataclass(frozen=True)
class Split:
    """Rows with ``x[feature] <= cut`` go left; ``share`` of the training rows did."""

    feature: int
    cut: float
    share: float
    left: Split | float
    right: Split | float


def paths(tree: Split | float, scale: float = 1.0) -> Iterator[tuple[float, Path]]:
    """(value, {feature: (low, high, share)}) of each leaf: the leaf is reached when
    every feature of its path lies in (low, high]; a feature that is left out
    passes with its share."""
    stack: list[tuple[Split | float, Path]] = [(tree, {})]
    while stack:
        node, path = stack.pop()
        if not isinstance(node, Split):
            yield scale * node, path
            continue
        low, high, share = path.get(node.feature, (float("-inf"), float("inf"), 1.0))
        stack.append((node.left, {**path, node.feature: (low, min(high, node.cut), share * node.share)}))
        stack.append((node.right, {**path, node.feature: (max(low, node.cut), high, share * (1 - node.share))}))


def grown(nodes: dict[int, object], at: int = 0) -> Split | float:
    """A tree from the node rows a saved model holds. The design has no nominal
    columns, so every split is a threshold."""
    node = nodes[at]
    if node["leftChild"] < 0:
        return node["prediction"]
    left = nodes[node["leftChild"]]
    share = left["rawCount"] / node["rawCount"] if node["rawCount"] else 0.0
    return Split(
        node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0], share,
        grown(nodes, node["leftChild"]), grown(nodes, node["rightChild"]),
    )
