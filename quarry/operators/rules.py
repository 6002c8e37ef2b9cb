"""Descriptor rules, parsing and per-row featurisers (B12–B24).  Every rule
is Column arithmetic over descriptor columns supplied by the caller, so the
row kernel is a parameter and the operator runs on any keyed table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# ---------------------------------------------------------------- B12
def preset_columns(available: Sequence[str], presets: Mapping[str, Sequence[str]], name: str,
                   add: Sequence[str] = (), remove: Sequence[str] = ()) -> list[str]:
    """Preset ∪ additions − removals, kept in available order."""
    base = presets.get(name, presets.get("default", []))
    chosen = (set(base) | set(add)) - set(remove)
    return [c for c in available if c in chosen]


# ---------------------------------------------------------------- B13
def lipinski(mw: Column, logp: Column, hbd: Column, hba: Column) -> tuple[Column, Column]:
    """violations = (mw>500)+(logp>5)+(hbd>5)+(hba>10); pass if ≤ 1."""
    v = ((mw > 500).cast("int") + (logp > 5).cast("int") + (hbd > 5).cast("int") + (hba > 10).cast("int"))
    return v, v <= 1


# ---------------------------------------------------------------- B14
def esol(logp: Column, mw: Column, rot: Column, arom: Column) -> tuple[Column, Column, Column]:
    """logS = 0.16 − 0.63·logP − 0.0062·MW + 0.066·RB − 0.74·AP;
    mg/ml = 10^logS·MW/1000; class bands >0 high, >−2 medium, >−4 low."""
    logs = F.lit(0.16) - 0.63 * logp - 0.0062 * mw + 0.066 * rot - 0.74 * arom
    mgml = F.pow(F.lit(10.0), logs) * mw / 1000
    cls = (F.when(logs > 0, "high").when(logs > -2, "medium").when(logs > -4, "low").otherwise("insoluble"))
    return logs, mgml, cls


# ---------------------------------------------------------------- B15
def admet(mw: Column, logp: Column, tpsa: Column, hbd: Column, basic_n: Column,
          n_alerts: Column) -> dict[str, Column]:
    """Empirical endpoints and the risk mean over present terms."""
    hia0 = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.lit(100.0) - tpsa / 2))
    hia = F.round(F.when(mw > 500, hia0 * 0.8).otherwise(hia0), 1)
    caco2 = F.round(F.lit(-5.0) - tpsa / 100 - mw / 1000, 2)
    bio = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - F.when(mw > 500, 20).otherwise(0)
                                       - F.when((logp > 5) | (logp < 0), 15).otherwise(0)
                                       - F.when(hbd > 5, 20).otherwise(0)))
    bbb = F.round(0.3 * logp - 0.02 * tpsa - 0.2 * hbd, 2)
    ppb = F.round(F.least(F.lit(99.0), F.greatest(F.lit(10.0), 50 + 10 * logp)), 1)
    vdss = F.round(0.5 + 0.3 * logp, 2)
    herg = (logp > 3.5) & basic_n
    absorption = F.when(hia != 0, hia / 100)
    cns = F.when(bbb != 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (bbb + 1) / 2)))
    safety = F.greatest(F.lit(0.0), F.lit(1.0) - 0.2 * n_alerts - F.when(herg, 0.3).otherwise(0.0))
    terms = F.array_compact(F.array(absorption, cns, safety))
    overall = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / F.size(terms)
    return {"hia": hia, "caco2": caco2, "bioavailability": bio.cast("double"), "pgp_substrate": (mw > 400) & (tpsa > 75),
            "bbb": bbb, "ppb": ppb, "vdss": vdss, "cyp3a4_inhibitor": (logp > 3) & (mw > 300),
            "herg_inhibition": herg, "ames_mutagenicity": n_alerts > 2,
            "absorption": absorption, "cns_penetration": cns, "safety": safety, "overall": overall}


# ---------------------------------------------------------------- B16
SEVERITY_WEIGHT = {"high": 3, "medium": 2, "low": 1}


def alert_profile(text: Column, rules: Sequence[tuple[str, str, str, str]],
                  categories: Sequence[str]) -> dict[str, Column]:
    """Rules are (pattern, name, category, severity).  Every match counts
    once (as each substructure match does); risk = min(1, Σ weight/10),
    toxic if risk > 0.3, one boolean per category.  The rule list is a
    driver constant, so it becomes columns — no join at all."""
    counts = [F.regexp_count(text, F.lit(p)) for p, _, _, _ in rules]
    weight = sum((c * SEVERITY_WEIGHT.get(sev, 1) for c, (_, _, _, sev) in zip(counts, rules)), F.lit(0))
    n_alerts = sum(counts, F.lit(0))
    risk = F.least(F.lit(1.0), weight / 10.0)
    out = {"n_alerts": n_alerts.cast("bigint"), "risk_score": risk, "is_flagged": risk > 0.3}
    for cat in categories:
        hits = [c > 0 for c, (_, _, rc, _) in zip(counts, rules) if rc == cat]
        out[cat] = F.greatest(*hits) if len(hits) > 1 else (hits[0] if hits else F.lit(False))
    return out


# ---------------------------------------------------------------- B17
def complexity_score(n_atoms: Column, n_rings: Column, n_stereo: Column, n_rot: Column,
                     n_alerts: Column) -> dict[str, Column]:
    """Complexity → score clamped to 1–10, +0.5 per alert, bands."""
    cx = n_atoms * 0.1 + n_rings * 0.5 + n_stereo * 1.0 + n_rot * 0.1
    sa = F.least(F.lit(10.0), F.lit(1.0) + F.least(F.lit(9.0), cx) + 0.5 * n_alerts)
    diff = F.when(sa <= 3, "easy").when(sa <= 5, "moderate").when(sa <= 7, "hard").otherwise("very_hard")
    return {"complexity": cx, "sa_score": sa, "difficulty": diff, "is_synthesizable": sa < 6}


# ---------------------------------------------------------------- B18
def logd_at(logp: Column, pka: Column, pkb: Column, ph: Column) -> Column:
    """logD = logP − 0.5·Σ acid ionised − 0.5·Σ base ionised fractions."""
    acid = F.aggregate(pka, F.lit(0.0), lambda a, k: a + 1 / (1 + F.pow(F.lit(10.0), k - ph)))
    base = F.aggregate(pkb, F.lit(0.0), lambda a, k: a + 1 / (1 + F.pow(F.lit(10.0), ph - k)))
    return logp - 0.5 * acid - 0.5 * base


def logd_curve(df: DataFrame, id_col: str, logp: str, pka: str, pkb: str,
               ph_lo: float = 0.0, ph_hi: float = 14.0, n_points: int = 50) -> DataFrame:
    """(id, i, pH, logD) on an ``n_points`` linspace grid."""
    step = (ph_hi - ph_lo) / (n_points - 1) if n_points > 1 else 0.0
    g = df.select(id_col, logp, pka, pkb, F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))).alias("i"))
    ph = F.lit(ph_lo) + F.col("i") * F.lit(step)
    return g.select(id_col, "i", ph.alias("ph"), logd_at(F.col(logp), F.col(pka), F.col(pkb), ph).alias("logd"))


def dominant_species(pka: Column, pkb: Column, ph: float = 7.4) -> Column:
    """Cationic / Anionic / Zwitterionic / Neutral at ``ph``."""
    neg = F.size(F.filter(pka, lambda k: F.lit(ph) > k + 1))
    pos = F.size(F.filter(pkb, lambda k: F.lit(ph) < k - 1))
    net = pos - neg
    n_groups = F.size(pka) + F.size(pkb)
    return (F.when(net > 0, "Cationic").when(net < 0, "Anionic")
            .when(n_groups > 0, "Zwitterionic").otherwise("Neutral"))


# ---------------------------------------------------------------- B19
# fixed values: residue masses used by the sequence mass rule
RESIDUE_MASS = {
    "A": 89.1, "R": 174.2, "N": 132.1, "D": 133.1, "C": 121.2,
    "E": 147.1, "Q": 146.1, "G": 75.1, "H": 155.2, "I": 131.2,
    "L": 131.2, "K": 146.2, "M": 149.2, "F": 165.2, "P": 115.1,
    "S": 105.1, "T": 119.1, "W": 204.2, "Y": 181.2, "V": 117.1,
}


def _chars(seq: Column) -> Column:
    return F.filter(F.split(F.upper(seq), ""), lambda c: F.length(c) > 0)


def sequence_mass(seq: Column) -> Column:
    """Σ residue mass − 18·(len − 1); unknown residues weigh 0.
    The 20-entry table is an inline map literal."""
    m = F.create_map(*[x for k, v in RESIDUE_MASS.items() for x in (F.lit(k), F.lit(v))])
    chars = _chars(seq)
    total = F.aggregate(chars, F.lit(0.0), lambda a, c: a + F.coalesce(m[c], F.lit(0.0)))
    return total - 18 * (F.size(chars) - 1)


def sequence_composition(df: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """(id, residue, fraction) via explode + group-by (id, residue)."""
    ex = df.select(id_col, F.explode(_chars(F.col(seq_col))).alias("residue"),
                   F.length(seq_col).alias("__len"))
    return ex.groupBy(id_col, "residue").agg((F.count(F.lit(1)) / F.first("__len")).alias("fraction"))


def motif_positions(seq: Column, motif: str) -> Column:
    """Overlapping 0-based offsets of ``motif`` (upper-cased match)."""
    s = F.upper(seq)
    m = motif.upper()
    n = F.length(s) - len(m)
    idx = F.sequence(F.lit(0), F.greatest(n, F.lit(-1)))
    return F.filter(F.when(n >= 0, idx).otherwise(F.array().cast("array<int>")),
                    lambda i: F.substring(s, i + 1, len(m)) == F.lit(m))


# ---------------------------------------------------------------- B20
def parse_mixture(s: Column) -> Column:
    """B20: 'A:60, B:40' | 'A|0.6|B|0.4' | 'A' → array<struct<key, ratio>>;
    ratios > 1 are percentages; unparsable parts are skipped."""
    piped = s.contains("|")
    tok = F.split(s, r"\|")
    n_pairs = F.floor(F.size(tok) / 2).cast("int")
    pipe_arr = F.transform(F.sequence(F.lit(0), F.greatest(n_pairs - 1, F.lit(0))),
                           lambda i: F.struct(F.trim(F.element_at(tok, i * 2 + 1)).alias("key"),
                                              F.trim(F.element_at(tok, i * 2 + 2)).try_cast("double").alias("ratio")))
    pipe_arr = F.when(n_pairs > 0, pipe_arr)
    parts = F.split(s, ",")
    colon_arr = F.transform(parts, lambda p: F.when(
        p.contains(":"),
        F.struct(F.trim(F.substring_index(p, ":", 1)).alias("key"),
                 F.trim(F.substring_index(p, ":", -1)).try_cast("double").alias("ratio"))).otherwise(
        F.struct(F.trim(p).alias("key"), F.lit(None).cast("double").alias("ratio"))))
    bare = F.array(F.struct(F.trim(s).alias("key"), F.lit(1.0).alias("ratio")))
    has_colon = s.contains(":")
    arr = F.when(piped, pipe_arr).when(has_colon, colon_arr).otherwise(bare)
    arr = F.filter(arr, lambda x: x["ratio"].isNotNull() & (F.length(x["key"]) > 0))
    return F.transform(arr, lambda x: F.struct(x["key"].alias("key"), F.when(x["ratio"] > 1, x["ratio"] / 100)
                                               .otherwise(x["ratio"]).alias("ratio")))


def format_mixture(arr: Column) -> Column:
    """B20: 'A:0.60, B:0.40' formatting."""
    return F.array_join(F.transform(arr, lambda x: F.concat(x["key"], F.lit(":"),
                                                             F.format_number(x["ratio"], 2))), ", ")


# ---------------------------------------------------------------- B21
def tokens(text: Column) -> Column:
    """Whitespace word tokens of the lower-cased text (empty dropped)."""
    return F.filter(F.split(F.lower(text), "[ \t\r\n]+"), lambda t: F.length(t) > 0)


def hashed_bits(toks: Column, n_bits: int = 2048, seed: str = "") -> Column:
    """Sorted distinct on-bits = md5-bucket of each token mod n_bits;
    null → empty set.  Portable: DuckDB computes the same bucket."""
    def bucket(t):
        return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(seed), t)), 1, 8), 16, 10).cast("bigint"),
                      F.lit(n_bits))
    return F.coalesce(F.array_sort(F.array_distinct(F.transform(toks, bucket))), F.array().cast("array<bigint>"))


# ---------------------------------------------------------------- B22
def fuse(a: Column, b: Column, how: str = "concat") -> Column:
    """Concat / average / max of two numeric arrays over the shorter length."""
    if how == "concat":
        return F.concat(a, b)
    n = F.least(F.size(a), F.size(b))
    sa, sb = F.slice(a, 1, n), F.slice(b, 1, n)
    if how == "average":
        return F.zip_with(sa, sb, lambda x, y: (x + y) / 2)
    if how == "max":
        return F.zip_with(sa, sb, lambda x, y: F.greatest(x, y))
    raise ValueError(how)


# ---------------------------------------------------------------- B24
def top_contributions(names: Sequence[str], contribs: Sequence[Column], k: int = 5) -> tuple[Column, Column]:
    """Names of the k largest positive and k most negative contributions
    (ties by name)."""
    arr = F.array(*[F.struct(c.alias("v"), F.lit(n).alias("f")) for n, c in zip(names, contribs)])
    pos = F.slice(F.array_sort(F.transform(F.filter(arr, lambda x: x["v"] > 0),
                                           lambda x: F.struct((-x["v"]).alias("k"), x["f"].alias("f")))), 1, k)
    neg = F.slice(F.array_sort(F.transform(F.filter(arr, lambda x: x["v"] < 0),
                                           lambda x: F.struct(x["v"].alias("k"), x["f"].alias("f")))), 1, k)
    return F.transform(pos, lambda x: x["f"]), F.transform(neg, lambda x: x["f"])
