"""Small coded fixtures and brute-force counterparts (NumPy, pairwise)."""

import numpy as np

from kinprofile.spec import FeatureSpec, Nominal, Ordinal

SPEC = FeatureSpec(
    "g", "id",
    (Nominal("a", ("x", "y", "z", "none"), "none"), Nominal("b", ("p", "q", "r"))),
    (Ordinal("o", (("o1", 1), ("o2", 2), ("o3", 3), ("o4", 4), ("o0", 0))),),
)


def random_rows(spark, n=400, groups=("u", "v"), seed=3, skew=True):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        p = [0.5, 0.2, 0.2, 0.1] if skew else [0.25] * 4
        rows.append((
            groups[i % len(groups)], i, str(rng.choice(["x", "y", "z", "none"], p=p)), str(rng.choice(["p", "q", "r"])),
            str(rng.choice(["o0", "o1", "o2", "o3", "o4"], p=[0.1, 0.4, 0.2, 0.2, 0.1])),
        ))
    return spark.createDataFrame(rows, "g string, id bigint, a string, b string, o string")


def planted_rows(spark, copies=24):
    """Three groups with four far-apart profiles each: duplicates and a few near variants."""
    profiles = [("x", "p", "o1"), ("y", "q", "o2"), ("z", "r", "o3"), ("none", "p", "o4")]
    rows, i = [], 0
    for g in ("u", "v", "w"):
        for truth, profile in enumerate(profiles):
            for _ in range(copies + 3 * truth):
                rows.append((g, i, *profile, truth))
                i += 1
            for _ in range(4):
                rows.append((g, i, *profile[:2], f"o{int(profile[2][1]) - 1}", truth))
                i += 1
    return spark.createDataFrame(rows, "g string, id bigint, a string, b string, o string, truth int")


def points(pdf, spec=SPEC):
    """Scaled one-hot matrix of a collected vector table."""
    columns = [(pdf[f.code] == level).astype(float).to_numpy() for f, level, _ in spec.one_hot]
    return np.array(columns + [pdf[o.scaled].to_numpy() for o in spec.ordinals]).T


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


def components(adjacent, allowed):
    comp = -np.ones(len(adjacent), int)
    found = 0
    for i in range(len(adjacent)):
        if allowed[i] and comp[i] < 0:
            stack = [i]
            comp[i] = found
            while stack:
                for t in np.nonzero(adjacent[stack.pop()] & allowed & (comp < 0))[0]:
                    comp[t] = found
                    stack.append(t)
            found += 1
    return comp


def brute_dbscan(d, w, first_row, eps, min_samples):
    near = d <= eps
    core = (near * w[None]).sum(1) >= min_samples
    order = np.argsort(first_row)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    comp = components(near[np.ix_(order, order)], core[order])[back]
    label = comp.copy()
    for i in np.nonzero(~core)[0]:
        seen = comp[near[i] & core]
        label[i] = seen.min() if len(seen) else -1
    return label


def brute_hdbscan(d, w, first_row, min_size, epsilons):
    """Top-down condensed tree over exact levels, excess of mass, threshold climbing."""
    n = int(w.sum())
    core = np.empty(len(w))
    for i in range(len(w)):
        order = np.argsort(d[i], kind="stable")
        core[i] = d[i][order][np.searchsorted(np.cumsum(w[order]), min(min_size + 1, n))]
    d = np.round(d, 9)
    core = np.round(core, 9)
    levels = np.unique(d[d >= core.min()])
    lam = lambda t: 1.0 / t if t > 0 else np.inf
    nodes = []

    def split(members, i, birth, parent):
        me = len(nodes)
        nodes.append({"birth": birth, "parent": parent, "own": {}, "children": [], "stability": 0.0})
        born = lam(birth) if birth is not None else 0.0
        while True:
            if i == 0:
                parts = []
            else:
                mask = np.zeros(len(w), bool)
                mask[members] = True
                comp = components(d <= levels[i - 1], mask & (core <= levels[i - 1]))
                parts = [np.nonzero(comp == c)[0] for c in range(comp.max() + 1)]
                parts = [p for p in parts if w[p].sum() >= min_size]
            stay = set(np.concatenate(parts)) if parts else set()
            for v in members:
                if v not in stay:
                    nodes[me]["own"][v] = levels[i]
                    nodes[me]["stability"] += w[v] * (lam(levels[i]) - born)
            if len(parts) == 1:
                members, i = parts[0], i - 1
                continue
            for p in parts:
                nodes[me]["stability"] += w[p].sum() * (lam(levels[i]) - born)
                nodes[me]["children"].append(split(p, i - 1, levels[i], me))
            return me

    split(np.arange(len(w)), len(levels) - 1, None, None)

    def below(c):
        return [x for k in nodes[c]["children"] for x in [k, *below(k)]]

    best, picked = [x["stability"] for x in nodes], set()
    for c in range(len(nodes) - 1, 0, -1):
        inner = sum(best[k] for k in nodes[c]["children"])
        if inner > best[c]:
            best[c] = inner
        else:
            picked = (picked - set(below(c))) | {c}
    out = {}
    for eps in epsilons:
        final = set()
        for c in picked:
            if nodes[c]["birth"] < eps:
                while nodes[c]["parent"] != 0:
                    c = nodes[c]["parent"]
                    if nodes[c]["birth"] > eps:
                        break
            final.add(c)
        final -= {x for c in final for x in below(c)}
        label = -np.ones(len(w), int)
        for rank, c in enumerate(sorted(final, key=lambda c: min(first_row[v] for k in [c, *below(c)] for v in nodes[k]["own"]))):
            for k in [c, *below(c)]:
                for v in nodes[k]["own"]:
                    label[v] = rank
        out[eps] = label
    return out


def brute_ari(a, b):
    a, b = np.asarray(a), np.asarray(b)
    same_a = a[:, None] == a[None]
    same_b = b[:, None] == b[None]
    upper = np.triu_indices(len(a), 1)
    x, y = same_a[upper], same_b[upper]
    both, total = (x & y).sum(), len(x)
    expected = x.sum() * y.sum() / total
    top = (x.sum() + y.sum()) / 2
    return 1.0 if top == expected else (both - expected) / (top - expected)
