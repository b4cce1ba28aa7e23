"""Least squares on sums of products, drop-one contributions and swap tests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trialloom.functions.blocks import in_parts, pair_blocks, released, written
from trialloom.functions.smallmath import ols, ols_r2, r2_lost, unpack
from trialloom.session import cut_lineage, spread
from trialloom.operators.derive import drop_one_family, term_name, term_value


PAIR_ROWS = 65_536  # pairs of units that a task hands on at once
FEW_GROUPS = 100_000  # whose numbers of blocks travel to the vectors
FEW_PAIRS = 64      # of a product of blocks at most 1 / FEW_PAIRS of the entries are computed one by one
ROUNDED = 1e-13     # of a sum of squares that is left where all values are equal
HELD_BYTES = 48_000_000  # of donor vectors that a task keeps for the next focal block


def gram(df: DataFrame, keys: list[str], columns: list[Column], out: str = "gram") -> DataFrame:
    """Upper triangle of the moment matrix of [1, columns...] per key, in one pass.

    Sums combine on the map side, so one row per key and task is all that is shuffled.
    """
    cols = [F.lit(1.0), *[c.cast("double") for c in columns]]
    named = df.select(*keys, *[c.alias(f"__x{i}") for i, c in enumerate(cols)])
    x = [F.col(f"__x{i}") for i in range(len(cols))]
    sums = [F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))]
    return named.groupBy(*keys).agg(F.array(*sums).alias(out))


def model_gram(df: DataFrame, keys: list[str], terms, response: str) -> DataFrame:
    """Moments of [1, terms..., response] over complete rows."""
    cols = [term_value(t) for t in terms]
    complete = df.where(F.col(response).isNotNull())
    for c in cols:
        complete = complete.where(c.isNotNull())
    return gram(complete, keys, [*cols, F.col(response)])


def _key_types(df: DataFrame, keys: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"{k} {types[k]}" for k in keys)


def _per_group(df: DataFrame, keys: list[str], schema: str, rows_of) -> DataFrame:
    """Rows made from each group's sums; ``rows_of(record)`` returns dicts without the keys."""
    def run(batches: Iterator[pd.DataFrame]):
        names = [p.split()[0] for p in schema.split(", ")]
        for pdf in batches:
            out = []
            for rec in pdf.to_dict("records"):
                out += [{**{k: rec[k] for k in keys}, **r} for r in rows_of(rec)]
            yield pd.DataFrame(out, columns=keys + names)

    return df.mapInPandas(run, f"{_key_types(df, keys)}, {schema}")


def ols_coefficients(grams: DataFrame, keys: list[str], terms) -> DataFrame:
    """Coefficient, standard error, t, R2 and n per term; nulls when the design is rank deficient."""
    names = [term_name(())] + [term_name(t) for t in terms]

    def rows(rec):
        g = unpack(rec["gram"], len(names) + 1)
        fit = ols(g, list(range(len(names))))
        if fit is None:
            return [dict(term=n, coef=None, coef_se=None, t=None, r2=None, n_trials=int(g[0, 0])) for n in names]
        b, cov, r2, n = fit
        se = np.sqrt(np.diag(cov))
        return [dict(term=t, coef=b[i], coef_se=se[i], t=b[i] / se[i] if se[i] > 0 else None, r2=r2, n_trials=int(n)) for i, t in enumerate(names)]

    return _per_group(grams, keys, "term string, coef double, coef_se double, t double, r2 double, n_trials long", rows)


def main_effects(coefs: DataFrame) -> DataFrame:
    """Main-effect rows of a full model."""
    return coefs.where((F.col("term") != "Intercept") & ~F.col("term").contains(":")).withColumnRenamed("term", "regressor")


def coefficient_features(coefs: DataFrame, keys: list[str], by_se: bool = False) -> DataFrame:
    """Coefficients (or t values) as long features (keys, feature, value)."""
    return coefs.select(*keys, F.col("term").alias("feature"), (F.col("t") if by_se else F.col("coef")).alias("value"))


def family_columns_of(full_terms, family) -> dict[str, list[int]]:
    at = {t: i + 1 for i, t in enumerate(full_terms)}
    return {name: [0] + [at[t] for t in terms] for name, terms in family.items()}


def drop_one(grams: DataFrame, keys: list[str], terms, predictors: list[str], min_trials: int = 0) -> DataFrame:
    """R2 of the full model and its loss without each predictor, from sub-blocks of one moment matrix.

    A group drops out whole when any member of its family cannot be fitted.
    """
    cols = family_columns_of(terms, drop_one_family(terms, predictors))

    def rows(rec):
        g = unpack(rec["gram"], len(terms) + 2)
        if g[0, 0] < min_trials:
            return []
        fits = {k: ols(g, c) for k, c in cols.items()}
        if any(f is None for f in fits.values()):
            return []
        full = fits["full"][2]
        return [dict(predictor=p, r2=full, delta_r2=full - fits[p][2], n_trials=int(g[0, 0])) for p in predictors]

    return _per_group(grams, keys, "predictor string, r2 double, delta_r2 double, n_trials long", rows)


def paired_moments(
    rows: DataFrame, group: list[str], unit: str, rank: str, focal: dict[str, Column | tuple[str, str]], donor: dict[str, Column | tuple[str, str]],
    products: dict[str, tuple[str, str]], block: int = 512, chunk: int = 512, finish: tuple[str, Callable] | None = None, drawn: DataFrame | None = None,
) -> DataFrame:
    """Sums over common ranks of focal x donor products for every ordered pair of units in a group.

    A pair is cut to the shorter unit. Units are cut into rank chunks, written compressed, and hashed into blocks; a task
    multiplies blocks of focal with blocks of donor vectors and adds up their chunks where it stands, so
    pairs are not shuffled. Every pair is the result asked for, so the row
    count is quadratic in the units of a group, not in their rows. ``focal`` and ``donor`` are columns, or two names whose
    product is formed in the tasks; a product with a column of ones is looked up in running sums.
    Output: group, unit, donor, one column per product; or the columns that ``finish`` (their schema, and a
    function of the dict of sums that returns a dict of columns and which pairs to keep) makes of the sums.

    With ``drawn`` (group, unit, its number ``place`` in the group from 0, ``draws``: an array of places) only the pairs drawn
    are formed. Output: group, unit, ``fits``: an array of (it, the columns of ``finish``) per unit and task, with a
    row for every draw, whose columns are null if the pair has no common rank or the donor is null.
    """
    columns = {f"f_{k}": c for k, c in focal.items()} | {f"d_{k}": c for k, c in donor.items()}
    own, chosen = [n for n, c in columns.items() if isinstance(c, Column)], drawn is not None
    vec = rows.select(*group, F.col(unit).alias("__u"), F.floor(F.col(rank) / chunk).alias("__c"), F.col(rank).alias("__r"), *[columns[n].cast("double").alias(n) for n in own])
    vec = vec.groupBy(*group, "__u", "__c").agg(F.sort_array(F.collect_list(F.struct("__r", *own))).alias("__v"))
    kept = StructType([*vec.select(*group, "__u", "__c").schema.fields, *StructType.fromDDL(", ".join(["__n int", *[f"{n} binary" for n in own]])).fields])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            v = batch.column(batch.num_columns - 1)
            ends, flat = np.append(0, np.cumsum(pc.list_value_length(v).to_numpy(zero_copy_only=False))), v.flatten()
            values = [flat.field(n).to_numpy(zero_copy_only=False).astype(float) for n in own]
            bytes_of = [pa.array([codec.compress(x[a:b].tobytes(), asbytes=True) for a, b in zip(ends[:-1], ends[1:])], pa.binary()) for x in values]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(ends), pa.int32()), *bytes_of], names=kept.names)

    vec = released(cut_lineage(vec.mapInArrow(pack, kept)))
    units = cut_lineage(vec.select(*group, "__u").distinct().groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / block).alias("__nb")))
    blocks, groups = units.agg(F.sum("__nb"), F.count(F.lit(1))).first()
    extra = []
    if chosen:  # a chunk before all others holds the places and draws of a block
        extra = ["__place", "__draws"]
        vec = vec.withColumns({"__place": F.lit(None).cast("long"), "__draws": F.lit(None).cast("array<int>")})
        told = drawn.select(*group, F.col(unit).alias("__u"), F.lit(-1).cast("long").alias("__c"), F.lit(0).alias("__n"), *[F.lit(None).cast("binary").alias(n) for n in own],
                            F.col("place").cast("long").alias("__place"), F.col("draws").cast("array<int>").alias("__draws"))
        vec = vec.unionByName(told)
    placed = vec.join(F.broadcast(units) if groups <= FEW_GROUPS else units, group).withColumn("__b", F.pmod(F.xxhash64("__u"), F.col("__nb")))
    packed = in_parts(placed, [*group, "__b"], blocks or 0).groupBy(*group, "__b", "__c").agg(F.sort_array(F.collect_list(F.struct("__u", "__n", *own, *extra))).alias("__v"))
    packed = written(packed.select(*group, "__b", "__c", *[F.col(f"__v.{n}").alias(n) for n in ("__u", "__n", *own, *extra)]), [*group, "__b", "__c"])
    place = [*group, "__b", "__c", "__u", "__n"]
    sides = [packed.select(*[F.col(c).alias(f"{s}{i}") for i, c in enumerate(place)], *[n for n in own if n.startswith(s)],
                           *([F.col(told_by).alias(f"{s}told")] if extra else [])) for s, told_by in (("f_", "__draws"), ("d_", "__place"))]
    met = F.lit(True)
    for i in [*range(len(group)), len(group) + 1]:
        met &= F.col(f"f_{i}") == F.col(f"d_{i}")
    types = dict(rows.dtypes)
    made, make = finish or (", ".join(f"{p} double" for p in products), lambda sums: (sums, True))
    schema = f"{_key_types(rows, group)}, {unit} {types[unit]}, " + (f"donor {types[unit]}, {made}" if not chosen else f"fits array<struct<it int, {made}>>")
    fields = list(to_arrow_schema(StructType.fromDDL(schema)))
    kind, n_key, specs = fields[len(group)].type, len(group) + 1, {
        s: {k: None if isinstance(c, Column) else c for k, c in side.items()} for s, side in (("f_", focal), ("d_", donor))}

    class Vectors:
        """The units of a block in one chunk: a row each, filled up with zeros."""

        def __init__(self, batch: pa.RecordBatch, row: int, s: str):
            self.units = batch.column(f"{s}{n_key + 1}")[row].values.cast(kind).to_pylist()
            self.sizes = batch.column(f"{s}{n_key + 2}")[row].values.to_numpy().astype(np.int64)
            self.told = batch.column(f"{s}told")[row].values if extra else None
            self.width, self.specs, self.values, self.ones, self.sums = int(self.sizes.max()), specs[s], {}, {}, {}
            self.inside = np.arange(self.width)[None, :] < self.sizes[:, None]
            for name in [n for n, parts in self.specs.items() if not parts] if self.width else []:
                codec, held = pa.Codec("zstd"), batch.column(f"{s}{name}")[row].values.to_pylist()
                flat = np.frombuffer(b"".join([codec.decompress(x, n, asbytes=True) for x, n in zip(held, (self.sizes * 8).tolist())]))
                m = np.zeros(self.inside.shape)
                m[self.inside] = flat
                self.values[name], self.ones[name] = m, bool((flat == 1.0).all())

        @property
        def nbytes(self) -> int:
            return sum(m.nbytes for m in self.values.values()) + sum(m.nbytes for m in self.sums.values())

        def matrix(self, name: str) -> np.ndarray:
            if name not in self.values:
                a, b = self.specs[name]
                self.values[name], self.ones[name] = self.matrix(a) * self.matrix(b), False
            return self.values[name]

        def one(self, name: str) -> bool:
            return self.ones.get(name, False)

        def prefix(self, name: str) -> np.ndarray:
            """Sums of the first values of each unit, how many is the second index; the last one holds beyond its end."""
            if name not in self.sums:
                self.sums[name] = np.pad(np.cumsum(self.matrix(name), axis=1), [(0, 0), (1, 0)])
            return self.sums[name]

    def product(f: Vectors, d: Vectors, a: str, b: str) -> np.ndarray:
        if f.one(a) and d.one(b):
            return np.minimum(f.sizes[:, None], d.sizes[None, :]).astype(float)
        if d.one(b):
            return np.take(f.prefix(a), np.minimum(d.sizes, f.width), axis=1)
        if f.one(a):
            return np.take(d.prefix(b), np.minimum(f.sizes, d.width), axis=1).T
        width = min(f.width, d.width)
        x, y = f.matrix(a)[:, :width], d.matrix(b)[:, :width]
        nx, ny = np.isnan(x), np.isnan(y)
        if not nx.any() and not ny.any():
            return x @ y.T
        out = np.where(nx, 0.0, x) @ np.where(ny, 0.0, y).T  # a missing value counts only where both units have a row
        out[(nx @ d.inside[:, :width].T.astype(float) + f.inside[:, :width].astype(float) @ ny.T) > 0] = np.nan
        return out

    def product_at(f: Vectors, d: Vectors, a: str, b: str, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The entries (i, j) of product()."""
        if f.one(a) and d.one(b):
            return np.minimum(f.sizes[i], d.sizes[j]).astype(float)
        if d.one(b):
            return f.prefix(a)[i, np.minimum(d.sizes[j], f.width)]
        if f.one(a):
            return d.prefix(b)[j, np.minimum(f.sizes[i], d.width)]
        width = min(f.width, d.width)
        if len(i) * FEW_PAIRS > len(f.sizes) * len(d.sizes) or np.isnan(f.matrix(a)).any() or np.isnan(d.matrix(b)).any():
            return product(f, d, a, b)[i, j]
        x, y, out = f.matrix(a), d.matrix(b), np.empty(len(i))
        for at in range(0, len(i), 1024):
            part = slice(at, at + 1024)
            out[part] = np.einsum("ij,ij->i", x[i[part], :width], y[j[part], :width])
        return out

    class Block:
        """The units of a block in order of appearance."""

        def __init__(self):
            self.at, self.units = {}, []

        def rows_of(self, v: Vectors) -> np.ndarray:
            for u in v.units:
                if u not in self.at:
                    self.at[u] = len(self.units)
                    self.units.append(u)
            return np.array([self.at[u] for u in v.units])

    def in_order(at: np.ndarray, size: int) -> bool:
        return len(at) == size and bool((at == np.arange(size)).all())

    def add(total: dict, f: Block, d: Block, fv: Vectors, dv: Vectors) -> None:
        """Adds the sums of one chunk for all pairs of two blocks."""
        i, j = f.rows_of(fv), d.rows_of(dv)
        shape = len(f.units), len(d.units)
        whole = in_order(i, shape[0]) and in_order(j, shape[1])
        for p, (a, b) in {"": (None, None), **products}.items():
            part = product(fv, dv, a, b) if p else np.ones((len(i), len(j)))
            if whole and p not in total:
                total[p] = np.ascontiguousarray(part)
                continue
            t = total.get(p, np.zeros((0, 0)))
            grow = [(0, n - have) for n, have in zip(shape, t.shape)]
            t = total[p] = np.pad(t, grow) if np.any(grow) else t
            if whole:
                t += part
            else:
                t[np.ix_(i, j)] += part

    def add_drawn(total: dict, f: Block, d: Block, fv: Vectors, dv: Vectors) -> None:
        """Adds the sums of one chunk for the pairs drawn; the first chunk tells which these are."""
        i, j = f.rows_of(fv), d.rows_of(dv)
        if not fv.width:
            places = dv.told.to_numpy()
            of = np.full(int(places.max()) + 1, -1)
            of[places] = np.where([u is None for u in dv.units], -2, np.arange(len(places)))
            draws, sizes = fv.told.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(fv.told).fill_null(0).to_numpy(zero_copy_only=False)
            inside = np.flatnonzero(draws < len(of))
            inside = inside[of[draws[inside]] != -1]
            total["i"] = np.repeat(np.arange(len(sizes)), sizes)[inside]
            total["it"] = (np.arange(len(draws)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[inside] + 1
            total["j"] = of[draws[inside]]
            total |= {p: np.zeros(len(inside)) for p in ("", *products)}
        if not fv.width or not total:  # a unit alone in its group draws nobody
            return
        f_row, d_row = np.full(len(f.units), -1), np.full(len(d.units) + 1, -1)  # a null donor's -2 is the last but one from the end ...
        f_row[i], d_row[j] = np.arange(len(i)), np.arange(len(j))
        both = np.flatnonzero((total["j"] >= 0) & (f_row[total["i"]] >= 0) & (d_row[total["j"]] >= 0))  # ... and is left out here
        x, y = f_row[total["i"][both]], d_row[total["j"][both]]
        total[""][both] += 1.0
        for p, (a, b) in products.items():
            total[p][both] += product_at(fv, dv, a, b, x, y)

    def columns_of(columns: dict, n: int, of: list) -> list[pa.Array]:
        return [c if isinstance(c, pa.Array) else pa.repeat(pa.scalar(c, x.type), n) if isinstance(c, str) else pa.array(c, x.type) for x in of for c in [columns[x.name]]]

    def done(key: tuple, f: Block, sums: dict) -> Iterator[pa.RecordBatch]:
        for d, total in sums.values():
            left, right = pa.array(f.units, kind), pa.array(d.units, kind)
            step = max(1, PAIR_ROWS // len(right))
            for at in range(0, len(total[""]), step):
                part = {p: t[at:at + step] for p, t in total.items()}
                i, j = np.repeat(np.arange(at, at + len(part[""])), part[""].shape[1]), np.tile(np.arange(part[""].shape[1]), len(part[""]))
                columns, keep = make({p: part[p].ravel() for p in products})
                us, ds = left.take(pa.array(i)), right.take(pa.array(j))
                same = pc.fill_null(pc.equal(us, ds), False).to_numpy(zero_copy_only=False)
                row = [*(pa.repeat(pa.scalar(k, x.type), len(i)) for k, x in zip(key[:-1], fields)), us, ds, *columns_of(columns, len(i), fields[n_key + 1:])]
                yield pa.RecordBatch.from_arrays(row, schema=pa.schema(fields)).filter(pa.array((part[""].ravel() > 0) & ~same & keep))

    def done_drawn(key: tuple, f: Block, sums: dict) -> Iterator[pa.RecordBatch]:
        if not any(t for _, t in sums.values()):
            return
        total = {p: np.concatenate([t[p] for _, t in sums.values()]) for p in ("i", "it", "", *products)}
        order = np.argsort(total["i"], kind="stable")
        total = {p: t[order] for p, t in total.items()}
        with np.errstate(divide="ignore", invalid="ignore"):
            columns, keep = make({p: total[p] for p in products})
        fit = list(fields[n_key].type.value_type)[1:]
        none = pa.array(~((total[""] > 0) & keep))
        values = [pc.if_else(none, pa.scalar(None, c.type), c) for c in columns_of(columns, len(order), fit)]
        at, n = np.unique(total["i"], return_counts=True)
        fits = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.StructArray.from_arrays([pa.array(total["it"], pa.int32()), *values], fields=list(fields[n_key].type.value_type)))
        row = [*(pa.repeat(pa.scalar(k, x.type), len(at)) for k, x in zip(key[:-1], fields)), pa.array(f.units, kind).take(pa.array(at)), fits.cast(fields[n_key].type)]
        yield pa.RecordBatch.from_arrays(row, schema=pa.schema(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, f, sums, last, fv = None, Block(), {}, None, None  # the focal block at hand, its sums with every donor block of the task
        held: dict[tuple, Vectors] = {}  # donor vectors, which come again with every focal block
        adds, ends = (add_drawn, done_drawn) if chosen else (add, done)
        for batch in batches:
            keys = [batch.column(f"{s}{i}").to_pylist() for s in ("f_", "d_") for i in range(n_key + 1)]
            last = None
            for row in range(batch.num_rows):
                f_key, d_key, c = tuple(h[row] for h in keys[:n_key]), tuple(h[row] for h in keys[n_key + 1:-1]), keys[n_key][row]
                if f_key != key:
                    if key is not None:
                        yield from ends(key, f, sums)
                    key, f, sums = f_key, Block(), {}
                if last != (f_key, c):
                    fv, last = Vectors(batch, row, "f_"), (f_key, c)
                dv = held.get((d_key, c))
                if dv is None:
                    if sum(v.nbytes for v in held.values()) > HELD_BYTES:
                        held.clear()
                    dv = held[d_key, c] = Vectors(batch, row, "d_")
                d, total = sums.setdefault(d_key, (Block(), {}))
                adds(total, f, d, fv, dv)
        if key is not None:
            yield from ends(key, f, sums)

    return pair_blocks(*sides, met, run, schema)


def swap_null(rows: DataFrame, group: list[str], unit: str, rank: str, terms, predictor: str, response: str) -> DataFrame:
    """delta R2 of one predictor after swapping its column for a donor's, for every donor of the group.

    Interactions follow the swapped column, other columns stay the focal unit's own. A pair whose
    full or reduced design is rank deficient gives no row.
    """
    size = len(terms) + 2
    rest = [(), *[tuple(x for x in t if x != predictor) for t in terms], None]
    own = [F.lit(1.0), *[term_value(t) for t in rest[1:-1]], F.col(response)]
    swapped = [False, *[predictor in t for t in terms], False]
    focal, products, named = {}, {}, {}
    order = {0: "one", 1: "x", 2: "xx"}
    first = {r: f"c{rest.index(r)}" for r in rest}
    focal |= {first[r]: own[rest.index(r)] for r in rest}
    for i in range(size):
        for j in range(i, size):
            # equal columns of a focal unit are held once, those of ones not multiplied
            pair = tuple(sorted((rest[i], rest[j]), key=str))
            name = named.setdefault(pair, f"m{i}_{j}" if () not in pair else first[pair[0] if pair[1] == () else pair[1]])
            if () not in pair:
                focal.setdefault(name, (first[pair[0]], first[pair[1]]))
            products[f"g{i}_{j}"] = (name, order[swapped[i] + swapped[j]])
    x = F.col(predictor)
    full = list(range(size - 1))
    reduced = [i for i in full if not swapped[i]]

    def delta(sums: dict[str, np.ndarray]) -> tuple[dict, np.ndarray]:
        g = [[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)]
        lost = r2_lost(g, reduced, [i for i in full if swapped[i]])
        some = np.flatnonzero(np.isnan(lost))  # no fit, or a design too close to one without
        if len(some):
            m = np.stack([np.stack([c[some] for c in r], axis=-1) for r in g], axis=-2)
            lost[some] = ols_r2(m, full) - ols_r2(m, reduced)
        return {"predictor": predictor, "delta_r2": lost}, ~np.isnan(lost)

    return paired_moments(rows, group, unit, rank, focal, {"one": F.lit(1.0), "x": x, "xx": ("x", "x")}, products, finish=("predictor string, delta_r2 double", delta))


def permutation_pvalues(null: DataFrame, observed: DataFrame, keys: list[str], value: str, alternative: str = "greater") -> DataFrame:
    """Add-one permutation p per key; two-sided is twice the smaller tail, at most 1."""
    from trialloom.functions.joins import skew_join

    j = skew_join(null.select(*keys, F.col(value).alias("__n")), observed.select(*keys, F.col(value).alias("observed")), keys)
    tail = lambda c: (F.count_if(c) + 1) / (F.count(F.lit(1)) + 1)
    up, down = tail(F.col("__n") >= F.col("observed")), tail(F.col("__n") <= F.col("observed"))
    p = {"greater": up, "less": down, "two-sided": F.least(F.lit(1.0), 2 * F.least(up, down))}[alternative]
    return j.groupBy(*keys).agg(F.max("observed").alias("observed"), p.alias("p_value"), F.count(F.lit(1)).alias("n_null"))


def synchronized_pvalues(null: DataFrame, observed: DataFrame, pool: list[str], stratum: str, index: str, value: str,
                         alternative: str = "greater") -> DataFrame:
    """Permutation p of a mean over strata whose null draws are aligned by ``index``.

    Strata of a pool must have equally many draws; ragged input raises.
    """
    obs = observed.groupBy(*pool).agg(F.avg(value).alias(value), F.count_distinct(stratum).alias("n_strata"))
    mean_null = null.groupBy(*pool, index).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("__k"))
    checked = mean_null.join(obs.select(*pool, "n_strata"), pool).withColumn(
        value, F.when(F.col("__k") == F.col("n_strata"), F.col(value)).otherwise(F.raise_error(F.lit("null vectors of unequal length")).cast("double")))
    p = permutation_pvalues(checked, obs, pool, value, alternative)
    return p.join(obs.select(*pool, "n_strata"), pool)


def numbered_donors(null: DataFrame, keys: list[str], unit: str, out: str, most: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """``null`` (one row per unit and donor) with the 0-based number of the donor among its unit's, in key order,
    and its units.

    A unit that met every donor of its group but itself needs no sorting: the number follows from the donor's place
    in the group. Only the rows of other units (pairs without a fit) are sorted. The table of units is small beside
    its pairs and travels to the tasks while it has at most ``most`` rows.
    """
    ends = null.select(*keys, F.inline(F.array(F.struct(F.col(unit).alias("__u"), F.lit(1).alias("__f"), F.lit(0).alias("__d")),
                                               F.struct(F.col("donor").alias("__u"), F.lit(0).alias("__f"), F.lit(1).alias("__d")))))
    met = ends.groupBy(*keys, "__u").agg(F.sum("__f").alias("__n"), F.max("__d").alias("__is")).withColumn("__is", F.col("__is").cast("long"))
    group = W.partitionBy(*keys)
    place = F.sum("__is").over(group.orderBy("__u").rowsBetween(W.unboundedPreceding, 0)) - F.col("__is")
    units = met.select(*keys, "__u", "__is", place.alias("__at"), "__n",
                       ((F.col("__n") == F.sum("__is").over(group) - F.col("__is")) & ~F.max(F.col("__u").isNull()).over(group)).alias("__all"))
    units = cut_lineage(units)
    seen = units.where("__n > 0").select(*keys, F.col("__u").alias(unit))
    few = units.count() <= most
    sent = lambda t: F.broadcast(t) if few else t
    j = null.join(sent(units.select(*keys, F.col("__u").alias(unit), F.col("__at").alias("__own"), F.col("__is").alias("__own_is"), "__all")), [*keys, unit])
    whole = j.where("__all").join(sent(units.select(*keys, F.col("__u").alias("donor"), "__at")), [*keys, "donor"])
    before = F.when((F.col("__own_is") == 1) & (F.col(unit) < F.col("donor")), 1).otherwise(0)
    whole = whole.select(*null.columns, (F.col("__at") - before).alias(out))
    if units.where("__n > 0 AND NOT __all").isEmpty():
        return whole, seen
    rest = j.where("NOT __all").withColumn(out, F.row_number().over(W.partitionBy(*keys, unit).orderBy("donor")) - 1)
    return whole.unionByName(rest.select(*null.columns, F.col(out).cast("long").alias(out))), seen


def swap_pvalue_table(null: DataFrame, observed: DataFrame, group: list[str], unit: str, subject: str) -> DataFrame:
    """Per (group, predictor, subject): mean drop-one contribution, p, number of sessions and of donors.

    Sessions without a null are left out; donors are numbered per session in key order. ``null`` is read
    twice (three times if some pairs have no fit) and not written out: its rows are quadratic in the sessions,
    what is kept of them is not.
    """
    keys = [*group, "predictor"]
    numbered, seen = numbered_donors(null, keys, unit, "__i")
    scorable = cut_lineage(observed.join(seen, [*keys, unit], "left_semi"))
    few = scorable.count() <= 2_000_000
    of = scorable.select(*keys, unit, subject)
    tagged = numbered.join(F.broadcast(of) if few else of, [*keys, unit])
    p = synchronized_pvalues(tagged, scorable, [*group, "predictor", subject], unit, "__i", "delta_r2")
    return p.select(*group, "predictor", subject, F.col("observed").alias("mean_delta_r2"), "p_value", F.col("n_strata").alias("n_sessions"), F.col("n_null").alias("n_donors"))


def pair_regressions(rows: DataFrame, group: list[str], unit: str, rank: str, fixed: str, swapped: str) -> DataFrame:
    """Slope and R2 of fixed ~ swapped for every (unit, donor) pair, cut to the shorter one."""
    f = {"one": F.lit(1.0), "y": F.col(fixed), "yy": ("y", "y")}
    d = {"one": F.lit(1.0), "x": F.col(swapped), "xx": ("x", "x")}

    def line(m: dict[str, np.ndarray]) -> tuple[dict, bool]:
        n = m["n"]
        cxx, cyy, cxy = m["sxx"] - m["sx"] ** 2 / n, m["syy"] - m["sy"] ** 2 / n, m["sxy"] - m["sx"] * m["sy"] / n
        none = (cxx <= 1e-9) | (cyy <= 1e-9)  # missing values stay NaN
        columns = {"slope": cxy / np.where(none, 1.0, cxx), "r2": cxy * cxy / np.where(none, 1.0, cxx * cyy)}
        return {"n": n.astype(np.int64)} | {k: pa.array(v, mask=none, from_pandas=False) for k, v in columns.items()}, True

    return paired_moments(rows, group, unit, rank, f, d, {
        "n": ("one", "one"), "sx": ("one", "x"), "sxx": ("one", "xx"), "sy": ("y", "one"), "syy": ("yy", "one"), "sxy": ("y", "x")},
        finish=("n long, slope double, r2 double", line))


def _packed(rows: DataFrame, group: list[str], unit: str, rank: str, column: str, name: str, chunk: int = 512) -> DataFrame:
    """One column of every unit as arrays over chunks of ranks; ranks count from 0 without gaps."""
    part = F.floor(F.col(rank) / chunk).alias("__c")
    held = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(column).cast("double").alias("v"))))
    return rows.groupBy(*group, F.col(unit).alias(name), part).agg(held.alias(f"__{name}"))


def _pair_rows(rows: DataFrame, pairs: DataFrame, group: list[str], unit: str, rank: str, fixed: str, swapped: str) -> DataFrame:
    """(group, unit, donor, y, x) rows of the given pairs, each cut to the shorter unit."""
    f, d = _packed(rows, group, unit, rank, fixed, unit), _packed(rows, group, unit, rank, swapped, "donor")
    j = pairs.join(f, [*group, unit]).join(d, [*group, "donor", "__c"])
    shorter = F.least(F.size(f"__{unit}"), F.size("__donor"))
    both = F.slice(F.arrays_zip(F.col(f"__{unit}.v").alias("y"), F.col("__donor.v").alias("x")), F.lit(1), shorter)
    return j.select(*group, unit, "donor", F.inline(both))


def tail_pvalue(null: str, observed: str, alternative: str) -> Column:
    """Add-one p of a row's observed value against its array of draws; draws without a value count in n."""
    share = lambda op: (F.size(F.filter(null, op)) + 1) / (F.size(null) + 1)
    up, down = share(lambda v: v >= F.col(observed)), share(lambda v: v <= F.col(observed))
    if alternative not in ("greater", "less", "two-sided"):
        raise ValueError(f"unknown alternative {alternative!r}")
    return {"greater": up, "less": down, "two-sided": F.least(F.lit(1.0), 2 * F.least(up, down))}[alternative]


def drawn_place(unit: Column, it: Column, seed: int, own: Column, n: Column) -> Column:
    """The place of the donor that ``unit`` (at place ``own`` of ``n``) draws in iteration ``it``: any but its own."""
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", unit, it, F.lit(seed)).cast("binary")), 1, 15), 16, 10).cast("long") % (n - 1)
    return hashed + F.when(hashed >= own, 1).otherwise(0)


def _touched(others: Column, n_iter: int) -> Column:
    """How many of ``others`` donors ``n_iter`` draws touch on average."""
    return others * (1 - F.pow(1 - 1 / others, F.lit(n_iter)))


def _drawn_regressions(rows: DataFrame, drawn: DataFrame, group: list[str], unit: str, rank: str, y: Column, x: Column) -> DataFrame:
    """(group, unit, fits): slope and R2 of y ~ x for the donors drawn, as regr_slope and regr_r2 over the pair's rows give them.

    Both are columns of doubles whose values are not far from 0, beside their spread.
    """
    f = {"has": y.isNotNull(), "y": F.coalesce(y, F.lit(0.0)), "yy": ("y", "y")}
    d = {"has": x.isNotNull(), "x": F.coalesce(x, F.lit(0.0)), "xx": ("x", "x")}

    def line(m: dict[str, np.ndarray]) -> tuple[dict, bool]:
        n = m["n"]
        sxx, syy, sxy = m["sxx"] - m["sx"] ** 2 / n, m["syy"] - m["sy"] ** 2 / n, m["sxy"] - m["sx"] * m["sy"] / n
        # equal values leave rounding errors of their size
        flat_x, flat_y = sxx <= ROUNDED * m["sxx"], syy <= ROUNDED * m["syy"]
        none = (n < 1) | flat_x
        r2 = np.where(flat_y, 1.0, sxy * sxy / np.where(none | flat_y, 1.0, sxx * syy))
        columns = {"slope": sxy / np.where(none, 1.0, sxx), "r2": r2}
        return {k: pa.array(v, mask=none, from_pandas=False) for k, v in columns.items()}, True

    return paired_moments(rows, group, unit, rank, f, d, {"n": ("has", "has"), "sx": ("has", "x"), "sxx": ("has", "xx"), "sy": ("y", "has"), "syy": ("yy", "has"), "sxy": ("y", "x")},
                          finish=("slope double, r2 double", line), drawn=drawn)


def session_permutation_test(rows: DataFrame, group: list[str], unit: str, rank: str, fixed: str, swapped: str, statistic: str,
                             n_iter: int, seed: int = 0, alternative: str = "two-sided", model: str = "linear") -> DataFrame:
    """Session-swap test of a regression of ``fixed`` on ``swapped`` with ``n_iter`` random donors per unit.

    Donors are drawn first (a hash of unit, draw and seed over the other units of the group), so at most n_iter pairs
    per unit are formed. Linear models are fitted where blocks of units meet: the draws of a unit travel
    there as an array, its vectors once; where the draws touch most pairs anyway, all of them come from block products.
    For logistic models each distinct pair is fitted once, from its rows. ``model`` is linear (slope, r2) or logistic
    (intercept, slope, pseudo_r2; ``fixed`` is 0 or 1). An empty ``group`` pools all units.
    Output per unit: p_value, error, and observed_<k> and null_<k> (in draw order) of every quantity.
    """
    stats = {"linear": ["slope", "r2"], "logistic": ["intercept", "slope", "pseudo_r2"]}[model]
    if statistic not in stats:
        raise KeyError(statistic)
    p_value = tail_pvalue(f"null_{statistic}", f"observed_{statistic}", alternative)
    pool = list(group) or ["__pool"]
    rows = rows if group else rows.withColumn("__pool", F.lit(0))
    w = W.partitionBy(*pool)
    own = [F.regr_slope(fixed, swapped).alias("slope"), F.regr_r2(fixed, swapped).alias("r2")] if model == "linear" else []
    units = rows.groupBy(*pool, unit).agg(F.min(F.col(fixed).cast("double")).alias("__y"), F.min(F.col(swapped).cast("double")).alias("__x"), *own)
    units = cut_lineage(units.select("*", (F.row_number().over(w.orderBy(unit)) - 1).alias("__i"), F.count(F.lit(1)).over(w).alias("__n")))
    every, hit, *near = units.where("__n > 1").select(F.sum(F.col("__n") - 1), F.sum(_touched(F.col("__n") - 1, n_iter)), F.avg("__y"), F.avg("__x")).first()
    seen = units.select(*pool, unit, *stats) if own else logistic_fit(rows, [*pool, unit], swapped, fixed)
    if model == "linear" and 2 * (hit or 0) <= (every or 0):
        place = lambda it: drawn_place(F.col(unit), it, seed, F.col("__i"), F.col("__n"))
        drawn = units.where("__n > 1").select(*pool, unit, F.col("__i").alias("place"), F.transform(F.sequence(F.lit(1), F.lit(n_iter)), lambda it: place(it).cast("int")).alias("draws"))
        y, x = (F.col(c).cast("double") - F.lit(at if at is not None and np.isfinite(at) else 0.0) for c, at in zip((fixed, swapped), near))
        fits = _drawn_regressions(rows, drawn, pool, unit, rank, y, x)
        null = fits.groupBy(*pool, unit).agg(F.sort_array(F.flatten(F.collect_list("fits"))).alias("__d"))
    else:
        draws = units.where("__n > 1").withColumn("it", F.explode(F.sequence(F.lit(1), F.lit(n_iter))))
        draws = draws.withColumn("__j", drawn_place(F.col(unit), F.col("it"), seed, F.col("__i"), F.col("__n")))
        draws = cut_lineage(draws.join(units.select(*pool, F.col("__i").alias("__j"), F.col(unit).alias("donor")), [*pool, "__j"]).select(*pool, unit, "it", "donor"))
        if model == "logistic":
            pairs = cut_lineage(draws.select(*pool, unit, "donor").distinct())
            fits = logistic_fit(_pair_rows(rows, pairs, pool, unit, rank, fixed, swapped), [*pool, unit, "donor"], "x", "y")
        else:
            fits = pair_regressions(rows, pool, unit, rank, fixed, swapped)
        drawn = draws.join(fits.select(*pool, unit, "donor", *stats), [*pool, unit, "donor"], "left")
        null = drawn.groupBy(*pool, unit).agg(F.sort_array(F.collect_list(F.struct("it", *stats))).alias("__d"))
    null = null.select(*pool, unit, *[F.col(f"__d.{k}").alias(f"null_{k}") for k in stats])
    seen = units.select(*pool, unit).join(seen, [*pool, unit], "left").select(*pool, unit, *[F.col(k).alias(f"observed_{k}") for k in stats])
    out = seen.join(null, [*pool, unit], "left")
    alone = F.when(F.col(f"null_{statistic}").isNull(), "no donor sessions").when(F.col(f"observed_{statistic}").isNull(), "stat: no value")
    p = F.when(F.col(f"null_{statistic}").isNotNull() & F.col(f"observed_{statistic}").isNotNull(), p_value)
    return out.withColumn("p_value", p).withColumn("error", alone).drop("__pool")


def logistic_fit(rows: DataFrame, keys: list[str], x: str, y: str, steps: int = 8) -> DataFrame:
    """Slope, intercept and pseudo R2 of a one-predictor logistic model per key, by Newton steps.

    Each step is one aggregate of the gradient and curvature sums; rows with the same (x, y) are
    counted once beforehand.
    """
    from trialloom.functions.joins import skew_join

    data = cut_lineage(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("__w")))
    params = data.groupBy(*keys).agg(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    eta = F.col("a") + F.col("b") * F.col(x)
    mu = 1 / (1 + F.exp(-eta))
    w = F.col("__w")
    for step in range(steps):
        s = skew_join(data, params, keys).withColumn("__mu", mu).withColumn("__q", F.col("__mu") * (1 - F.col("__mu")))
        g = s.groupBy(*keys).agg(F.first("a").alias("a"), F.first("b").alias("b"), F.sum(w * (F.col(y) - F.col("__mu"))).alias("g0"), F.sum(w * (F.col(y) - F.col("__mu")) * F.col(x)).alias("g1"),
                                 F.sum(w * F.col("__q")).alias("h00"), F.sum(w * F.col("__q") * F.col(x)).alias("h01"), F.sum(w * F.col("__q") * F.col(x) ** 2).alias("h11"))
        det = F.col("h00") * F.col("h11") - F.col("h01") ** 2
        ok = det > 1e-12
        params = g.select(*keys, (F.col("a") + F.when(ok, (F.col("h11") * F.col("g0") - F.col("h01") * F.col("g1")) / F.when(ok, det)).otherwise(0.0)).alias("a"),
                          (F.col("b") + F.when(ok, (F.col("h00") * F.col("g1") - F.col("h01") * F.col("g0")) / F.when(ok, det)).otherwise(0.0)).alias("b"))
        if step % 3 == 2:
            params = cut_lineage(params)
    ll = w * F.when(F.col(y) == 1, -F.log1p(F.exp(-eta))).otherwise(-F.log1p(F.exp(eta)))
    fit = skew_join(data, params, keys).groupBy(*keys).agg(
        F.first("a").alias("intercept"), F.first("b").alias("slope"), F.sum(ll).alias("__ll"), F.sum(w).alias("__n"), F.sum(w * F.col(y)).alias("__k"))
    p = F.col("__k") / F.col("__n")
    null = F.when((p > 0) & (p < 1), F.col("__k") * F.ln(F.when(p > 0, p)) + (F.col("__n") - F.col("__k")) * F.ln(F.when(p < 1, 1 - p)))
    return fit.select(*keys, "intercept", "slope", (1 - F.col("__ll") / null).alias("pseudo_r2"))
