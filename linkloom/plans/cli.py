"""Command line: `discover`, `candidates`, `samples` and `batches` over the example tables, resumable under --out."""

from __future__ import annotations

import argparse

from linkloom.operators import graph as G
from linkloom.plans import pipeline as L
from linkloom.plans import trade as X
from linkloom.plans.schema import read_config
from linkloom.session import build_session


def parse(arguments: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("step", choices=["discover", "candidates", "samples", "batches"])
    p.add_argument("--config", help="JSON or YAML with max_hop, max_instance, max_neighbor, top_k, neg_ratios, max_positive, u_batches, v_batches, seed")
    p.add_argument("--data", default="/root/testdata/sf0.01")
    p.add_argument("--out", required=True, help="folder with its scheme, such as file:///tmp/out")
    p.add_argument("--platform", choices=["local", "cluster"], default="local")
    p.add_argument("--force", action="store_true", help="make every step anew")
    out = p.parse_args(arguments)
    if "://" not in out.out and not out.out.startswith("file:/"):
        p.error("--out needs a scheme")
    return out


def main(arguments: list[str] | None = None) -> None:
    a = parse(arguments)
    c = {"max_hop": 4, "max_instance": 20, "max_neighbor": 20, "top_k": 5, "neg_ratios": [1, 3], "max_positive": None, "u_batches": 2, "v_batches": 2, "seed": "s"} | (read_config(a.config) if a.config else {})
    spark = build_session(a.platform)
    steps = L.Steps(spark, a.out, a.force)
    settings = G.Discovery(X.CUSTOMER, X.PART, c["max_hop"], c["max_instance"], None, c["seed"])
    u, v, known, targets = X.customer_seeds(spark, a.data), X.part_seeds(spark, a.data), X.known(spark, a.data), X.targets(spark, a.data)
    ranked = L.discovery(steps, X.SCHEMA, X.edge_tables(spark, a.data), u, v, targets, known, settings, c["max_neighbor"])
    if a.step == "discover":
        return G.order_types(ranked, c["max_hop"]).show(20)
    pairs = L.candidates(steps, ranked, u, v, known, settings, c["top_k"])
    if a.step == "samples":
        return L.samples(steps, pairs, targets, c["neg_ratios"], c["max_positive"], c["seed"]).groupBy("neg_ratio", "label").count().show()
    if a.step == "batches":
        return L.inference_batches(steps, pairs, c["u_batches"], c["v_batches"], c["seed"]).groupBy("batch_id").count().show()
    return print(pairs.count(), "candidate pairs")


if __name__ == "__main__":
    main()
