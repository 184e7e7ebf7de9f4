"""Structure metrics over atom tables: chains, proximity, classes, superposition, RMSD and confidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspan.schemas import aa_dim
from foldspan.sources.scratch import stored


def list_chains(atoms: DataFrame) -> DataFrame:
    return atoms.filter(F.trim("chain") != "").select("structure_id", "chain").distinct()


def resi_sort_key(resi: Column) -> Column:
    """Struct that orders residue numbers: signed digits, then insertion code; what is no number comes last."""
    found = F.regexp_extract(resi, "^(-?)(\\d+)(.*)$", 2)
    sign = F.when(F.regexp_extract(resi, "^(-?)(\\d+)(.*)$", 1) == "-", -1).otherwise(1)
    value = F.when(found != "", sign * F.nullif(found, F.lit("")).cast("long"))
    return F.struct(value.isNull().alias("last"), value.alias("number"), F.when(found != "", F.regexp_extract(resi, "^(-?)(\\d+)(.*)$", 3)).otherwise(resi).alias("suffix"))


def _cells(atoms: DataFrame, width: float) -> DataFrame:
    """atoms with the cell (i, j, k) of a grid of this width that each stands in."""
    return atoms.withColumns({n: F.floor(F.col(c) / F.lit(width)).cast("long") for n, c in zip("ijk", "xyz", strict=True)})


def _around(atoms: DataFrame, width: float) -> DataFrame:
    """(structure_id, i, j, k, u, v, w): the place of each atom in its own cell and the 26 about it."""
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)))
    spread = _cells(atoms, width).withColumn("s", F.explode(steps))
    return spread.select("structure_id", *((F.col(n) + F.col(f"s.{a}")).alias(n) for n, a in zip("ijk", "abc", strict=True)), F.col("x").alias("u"), F.col("y").alias("v"), F.col("z").alias("w"))


def _square() -> Column:
    return (F.col("x") - F.col("u")) ** 2 + (F.col("y") - F.col("v")) ** 2 + (F.col("z") - F.col("w")) ** 2


def residues_within(atoms: DataFrame, chain_a: str, chain_b: str, distance: float) -> DataFrame:
    """(structure_id, resn, resi) of residues of chain_a with an atom within distance of chain_b, each once, by its CA.

    A grid of cells as wide as the distance makes the range join an equi-join: atoms of chain_b, a ligand or binder,
    stand in their 27 neighbouring cells, and those of chain_a meet them by structure and cell.
    """
    mine = _cells(atoms.filter(F.col("chain") == chain_a), distance)
    hit = mine.join(_around(atoms.filter(F.col("chain") == chain_b), distance), ["structure_id", "i", "j", "k"]).filter(_square() <= distance**2).select("structure_id", "resi").distinct()
    whole = atoms.filter((F.col("chain") == chain_a) & (F.col("atom_name") == "CA"))
    return whole.join(hit, ["structure_id", "resi"], "left_semi").select("structure_id", "resn", "resi").distinct()


def min_distances(atoms: DataFrame, chain_a: str, chain_b: str, width: float = 4.0) -> DataFrame:
    """(structure_id, resi, resn, min_dist): for each residue of chain_a the distance of its nearest atom to the nearest atom
    of chain_b. Structures without chain_b have no rows.

    No radius is given, so the grid is widened. In a grid of cells as wide as w an atom meets all partners within w, and so
    a residue's least distance is certain if it is at most w. Residues that are not certain meet the partners again in
    cells twice as wide, until all are; their number falls from round to round. The widest cell spans a structure.
    """
    finite = atoms.filter(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in "xyz")).select("structure_id", "chain", "resi", "resn", "x", "y", "z")
    partners = stored(finite.filter(F.col("chain") == chain_b).select("structure_id", "x", "y", "z"), "partners")
    open_ = stored(finite.filter(F.col("chain") == chain_a).join(partners.select("structure_id").distinct(), "structure_id", "left_semi"), "residues")
    if open_.isEmpty():
        return open_.select("structure_id", "resi", "resn", F.lit(None).cast("double").alias("min_dist"))
    ends = open_.select("structure_id", "x", "y", "z").unionByName(partners).groupBy("structure_id").agg(*((F.max(c) - F.min(c)).alias(c) for c in "xyz"))
    widest, done = ends.agg(F.max(F.greatest("x", "y", "z"))).first()[0] * 3**0.5, None
    while True:
        near = _cells(open_, width).join(_around(partners, width), ["structure_id", "i", "j", "k"]).groupBy("structure_id", "resi", "resn").agg(F.sqrt(F.min(_square())).alias("min_dist"))
        found = stored(near if width > widest else near.filter(F.col("min_dist") <= width), "distances")
        done = found if done is None else done.unionByName(found)
        if width > widest:
            return done
        open_ = stored(open_.join(found, ["structure_id", "resi", "resn"], "left_anti"), "residues")
        if open_.isEmpty():
            return done
        width *= 2


def classify_residues(residues: DataFrame) -> DataFrame:
    """Adds one-letter code and polarity group; unknown residues go. The dimension has twenty rows."""
    dim = aa_dim(residues.sparkSession).select(F.col("resn").alias("__resn"), "aa", "polarity")
    return residues.join(F.broadcast(dim), F.col("resn") == F.col("__resn")).drop("__resn")


def matched(atoms: DataFrame, pairs: DataFrame, by: tuple = ("chain", "resi")) -> DataFrame:
    """CA atoms of the target and reference of each pair (pair_id, target, reference), matched on by."""
    ca = atoms.filter(F.col("atom_name") == "CA").select("structure_id", *by, "x", "y", "z")
    first = ca.select(F.col("structure_id").alias("target"), *by, *(F.col(c).alias(f"t{c}") for c in "xyz"))
    second = ca.select(F.col("structure_id").alias("reference"), *by, *(F.col(c).alias(f"r{c}") for c in "xyz"))
    return pairs.join(first, "target").join(second, ["reference", *by])


def fits(points: DataFrame) -> DataFrame:
    """(pair_id, n, rotation, shift) of the least-squares fit of targets on references, from matched points.

    Sums of coordinates and of their products are plain aggregates, combined before the shuffle; only the 3 x 3 matrix of a
    pair reaches Python. Fewer than three points give no fit. Reflections are excluded.
    """
    one = points.groupBy("pair_id").agg(
        F.count("*").alias("n"), *(F.avg(f"{s}{c}").alias(f"{s}{c}") for s in "tr" for c in "xyz"),
        *(F.avg(F.col(f"t{a}") * F.col(f"r{b}")).alias(f"m{a}{b}") for a in "xyz" for b in "xyz"),
    )

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                if r.n < 3:
                    out.append((r.pair_id, r.n, None, None))
                    continue
                t, o = np.array([r.tx, r.ty, r.tz]), np.array([r.rx, r.ry, r.rz])
                h = np.array([[getattr(r, f"m{a}{b}") for b in "xyz"] for a in "xyz"]) - np.outer(t, o)
                u, _, v = np.linalg.svd(h)
                d = np.sign(np.linalg.det(v.T @ u.T)) or 1.0
                rotation = v.T @ np.diag([1, 1, d]) @ u.T
                out.append((r.pair_id, r.n, rotation.ravel().tolist(), (o - rotation @ t).tolist()))
            yield pd.DataFrame(out, columns=["pair_id", "n", "rotation", "shift"])

    return one.mapInPandas(solve, "pair_id string, n long, rotation array<double>, shift array<double>")


def moved(df: DataFrame, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """df with coordinates turned by rotation and shifted, where a fit is present."""
    r, s = F.col("rotation"), F.col("shift")
    place = lambda k: F.coalesce(r[3 * k] * F.col(x) + r[3 * k + 1] * F.col(y) + r[3 * k + 2] * F.col(z) + s[k], F.col((x, y, z)[k]))
    return df.withColumns({x: place(0), y: place(1), z: place(2)}).drop("rotation", "shift")


def superpose(atoms: DataFrame, pairs: DataFrame) -> DataFrame:
    """Atoms of each pair's target, moved onto its reference by a fit of matched CA atoms."""
    fit = fits(matched(atoms, pairs))
    return moved(pairs.join(fit, "pair_id").join(atoms.withColumnRenamed("structure_id", "target"), "target"))


def rmsd(atoms: DataFrame, pairs: DataFrame, design_chain: str) -> DataFrame:
    """(pair_id, rmsd, binder_rmsd): over all matched CA atoms, and over the design chain with its own fit. Where the
    complex cannot be matched, its value is the binder's; unavailable is null.

    The least sum of squares after a fit is what the coordinates' own spreads leave when the singular values of their
    covariance are taken off twice, the smallest with the sign that excludes a reflection. So one join of the atoms and one
    aggregate, combined before its shuffle, give both values; no atom is moved.
    """
    points = matched(atoms, pairs)
    sums = []
    for name, counts in (("whole", F.lit(True)), ("binder", F.col("chain") == design_chain)):
        some = lambda c, counts=counts: F.when(counts, c)
        sums += [F.count(some(F.lit(1))).alias(f"{name}_n"), *(F.avg(some(F.col(f"{s}{c}"))).alias(f"{name}_{s}{c}") for s in "tr" for c in "xyz")]
        sums += [F.avg(some(F.col(f"t{a}") * F.col(f"r{b}"))).alias(f"{name}_m{a}{b}") for a in "xyz" for b in "xyz"]
        sums += [F.avg(some(sum((F.col(f"{s}{c}") ** 2 for c in "xyz"), F.lit(0.0)))).alias(f"{name}_q{s}") for s in "tr"]
    one = points.groupBy("pair_id").agg(*sums)

    def value(r, name: str) -> float | None:
        if getattr(r, f"{name}_n") < 3:
            return None
        t, o = (np.array([getattr(r, f"{name}_{s}{c}") for c in "xyz"]) for s in "tr")
        h = np.array([[getattr(r, f"{name}_m{a}{b}") for b in "xyz"] for a in "xyz"]) - np.outer(t, o)
        spread = getattr(r, f"{name}_qt") - t @ t + getattr(r, f"{name}_qr") - o @ o
        size = np.linalg.svd(h, compute_uv=False)
        size[2] *= np.sign(np.linalg.det(h)) or 1.0
        return float(np.sqrt(max(0.0, spread - 2 * size.sum())))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = list(f.itertuples(index=False))
            yield pd.DataFrame({"pair_id": f["pair_id"], "whole": [value(r, "whole") for r in rows], "binder_rmsd": [value(r, "binder") for r in rows]}).astype({"whole": "object", "binder_rmsd": "object"})

    both = pairs.select("pair_id").join(one.mapInPandas(solve, "pair_id string, whole double, binder_rmsd double"), "pair_id", "left")
    return both.select("pair_id", F.coalesce("whole", "binder_rmsd").alias("rmsd"), "binder_rmsd")


def mean_plddt(atoms: DataFrame, chain: str) -> DataFrame:
    """Mean confidence of a chain's residues, by their CA atoms."""
    return atoms.filter((F.col("chain") == chain) & (F.col("atom_name") == "CA")).groupBy("structure_id").agg(F.avg("b").alias("plddt"))


def ipae(matrix: Column, length: Column) -> Column:
    """Mean of the means of both off-diagonal blocks of a square error matrix split at length; null unless 0 < length < n."""
    n = F.size(matrix)
    total = lambda rows, at, many: F.aggregate(F.transform(rows, lambda r: F.aggregate(F.slice(r, at, many), F.lit(0.0), lambda a, x: a + x)), F.lit(0.0), lambda a, x: a + x)
    rest = n - length
    value = (total(F.slice(matrix, F.lit(1), length), length + 1, rest) + total(F.slice(matrix, length + 1, rest), F.lit(1), length)) / (length * rest) / 2
    return F.when((length > 0) & (length < n), value)


def conservation(alignment: DataFrame) -> DataFrame:
    """(index, entropy, gap_fraction) of alignment columns; entropy in bits over residues, gaps left out."""
    counts = alignment.groupBy("index", F.coalesce("res_aa", F.lit("-")).alias("aa")).agg(F.count("*").alias("n"))
    total = counts.groupBy("index").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("aa") != "-", F.col("n")).otherwise(0)).alias("known"))
    p = F.col("n") / F.col("known")
    part = F.when((F.col("aa") != "-"), -p * F.log2(p)).otherwise(0.0)
    return counts.join(total, "index").groupBy("index").agg(F.sum(part).alias("entropy"), F.max((F.col("all") - F.col("known")) / F.col("all")).alias("gap_fraction"))


#: Atoms of a residue's backbone.
BACKBONE = ("N", "CA", "C", "O")


def residue_distances(atoms: DataFrame, chain_a: str, chain_b: str, width: float = 4.0) -> DataFrame:
    """min_distances() with three more columns: the least and the mean distance of a residue's atoms to the centroid of
    chain_b, and the mean of its backbone atoms. The centroid is one row a structure."""
    known = atoms.filter(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in "xyz"))
    center = known.filter(F.col("chain") == chain_b).groupBy("structure_id").agg(*(F.avg(c).alias(n) for c, n in zip("xyz", "uvw", strict=True)))
    far = F.sqrt(_square())
    spread = known.filter(F.col("chain") == chain_a).join(center, "structure_id").groupBy("structure_id", "resi", "resn").agg(
        F.min(far).alias("min_dist_to_centroid"), F.avg(far).alias("dist_to_centroid"), F.avg(F.when(F.col("atom_name").isin(*BACKBONE), far)).alias("dist_backbone_to_centroid"),
    )
    return min_distances(atoms, chain_a, chain_b, width).join(spread, ["structure_id", "resi", "resn"])


def pocket_descriptors(residues: DataFrame, near: float = 6.0) -> DataFrame:
    """Descriptors of pocket residues (structure_id, resn, min_dist) by shell, nearer than near or not: volumes, hydropathy,
    polarity and class shares, each plain and weighted by nearness; where residues have distances to the centroid, their
    means too. Unknown residues do not count."""
    dim = F.broadcast(aa_dim(residues.sparkSession))
    shell = F.when(F.col("min_dist") < near, "proximal").otherwise("distal")
    weight = 1 / F.greatest(F.col("min_dist"), F.lit(1e-6))
    weighted = lambda c: F.sum(c * weight) / F.sum(weight)
    part = lambda c: F.when(c, 1.0).otherwise(0.0)
    small, bulky = part(F.col("volume") < 90), part(F.col("volume") >= 124)
    means = [F.avg(c).alias(f"mean_{c}") for c in ("min_dist_to_centroid", "dist_to_centroid", "dist_backbone_to_centroid") if c in residues.columns]
    return residues.join(dim, "resn").groupBy("structure_id", shell.alias("shell")).agg(
        F.count("*").alias("n"), *means, F.avg("volume").alias("mean_volume"), weighted(F.col("volume")).alias("weighted_mean_volume"), F.var_samp("volume").alias("volume_variance"),
        F.avg(small).alias("small_residue_frac"), weighted(small).alias("small_residue_frac_weighted"), F.avg(bulky).alias("bulky_residue_frac"), weighted(bulky).alias("bulky_residue_frac_weighted"),
        F.avg("kd").alias("kd_mean"), weighted(F.col("kd")).alias("kd_weighted"), F.avg("hw").alias("hw_mean"), weighted(F.col("hw")).alias("hw_weighted"),
        F.avg(part(F.col("polarity").isin("p+", "p-"))).alias("charged_fraction"), F.avg(part(F.col("polarity") != "np")).alias("polar_fraction"),
    )


def pocket_table(descriptors: DataFrame) -> DataFrame:
    """The wide table that pocket profiles take: one row a structure, each descriptor once for each shell as 'name (shell)',
    and the residues of the pocket and of its near shell."""
    names = [c for c in descriptors.columns if c not in ("structure_id", "shell", "n")]
    at = lambda c, s: F.max(F.when(F.col("shell") == s, F.col(c)))
    wide = [at(c, s).alias(f"{c} ({s})") for c in names for s in ("distal", "proximal")]
    counts = (F.sum("n").alias("num_pocket_res_ali"), F.coalesce(F.sum(F.when(F.col("shell") == "proximal", F.col("n"))), F.lit(0)).alias("num_pocket_res<6"))
    return descriptors.groupBy(F.col("structure_id").alias("struct_name")).agg(*counts, *wide)
