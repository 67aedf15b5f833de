"""The registered queries, one or more per operator.

Each reads the whole of its tables in ``sf_dir`` and returns a DataFrame.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from coordloom import inputs
from coordloom.functions import COMPONENTWISE, parse_complex
from coordloom.operators import (
    AxisOperator, abs_square, apply_on_axis, axis_form, iterate_reflect, kron, marginal, marginals,
    matmul, norm, prune_zeros, ravel, reflect, reshape, self_product, sum_axis,
)
from coordloom.plans import chain_apply, chain_history, compose, run
from coordloom.session import new_folder
from coordloom.sources import (
    LEFT, RIGHT, basis_vector, cyclic_shift, format_coo, identity, load_coo, parse_coo, read_coo,
    read_headers, read_norm, read_parquet, read_tensor, save_coo, store_bucketed, store_split, to_coo, uniform_vector,
    write_coo, write_norm, write_parquet, write_tensor,
)
from coordloom.table import CooTable, TensorTable, check_bounds

Query = Callable[[SparkSession, str], DataFrame]


def coo_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.customer_supplier(spark, sf_dir).entries()


def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = inputs.customer_supplier(spark, sf_dir).df
    return a.agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"),
                 F.count("*").alias("entries"))


def matmul_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = inputs.customer_supplier(spark, sf_dir, merge=False)
    return matmul(a, inputs.supplier_line(spark, sf_dir, a.dims[1])).entries()


def matmul_componentwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = inputs.customer_supplier(spark, sf_dir, merge=False)
    return matmul(a, inputs.supplier_line(spark, sf_dir, a.dims[1]), COMPONENTWISE).entries()


def matvec(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = inputs.customer_supplier(spark, sf_dir, merge=False)
    return matmul(a, inputs.supplier_vector(spark, sf_dir, a.dims[1])).entries()


def matvec_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = store_bucketed(inputs.customer_supplier(spark, sf_dir))
    return matmul(a, inputs.supplier_vector(spark, sf_dir, a.dims[1])).entries()


def gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return self_product(inputs.embedding_matrix(spark, sf_dir).transpose()).df


def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return self_product(inputs.supplier_part(spark, sf_dir)).df


def kron_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kron(inputs.region_nation(spark, sf_dir),
                inputs.supplier_line(spark, sf_dir)).entries()


def kron_componentwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kron(inputs.region_nation(spark, sf_dir),
                inputs.supplier_line(spark, sf_dir), COMPONENTWISE).entries()


def frobenius_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm(inputs.customer_supplier(spark, sf_dir))


def norm_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norm of the embeddings as they are, not rounded to thousandths: the same bits however
    the rows are dealt."""
    cells = inputs.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode("embedding").alias("position", "x"))
    n = inputs.key_space(spark, sf_dir, "embeddings", "vec_id")
    width = cells.agg(F.max("position")).first()[0] + 1
    return norm(to_coo(cells, "vec_id", "position", "x", dims=(n, width), key=True), exact=True)


def sum_axis_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as they are, summed over two axes of four."""
    rows = inputs.round_up(inputs.events(spark, sf_dir), 1000)
    v = to_coo(inputs.table(spark, sf_dir, "events"), "event_id", F.lit(0), "value", dims=(rows, 1), key=True)
    return sum_axis(reshape(v, (rows // 1000, 10, 10, 10)), [1, 3], exact=True).df


def squared_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = abs_square(inputs.customer_supplier(spark, sf_dir))
    return t.df.withColumnRenamed("re", "val")


def reshape_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_array(spark, sf_dir).df


def ravel_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ravel(_event_array(spark, sf_dir)).df


def _event_array(spark: SparkSession, sf_dir: str):
    v, shape = inputs.shaped_event_vector(spark, sf_dir)
    return reshape(v, shape)


def sum_two_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sum_axis(_event_array(spark, sf_dir), [1, 3]).df


def sum_all_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sum_axis(_event_array(spark, sf_dir), [1, 2, 3, 4]).df


def sum_axis_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sum_axis(_event_array(spark, sf_dir), [1], ("?", "?", 5, 5)).df


def sum_axis_leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sum_axis(_event_array(spark, sf_dir), [4], (0, 3, "?", "?")).df


def event_marginal(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, shape = inputs.shaped_event_vector(spark, sf_dir)
    return marginal(v, shape, [2, 4]).df


def marginal_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, shape = inputs.shaped_event_vector(spark, sf_dir)
    return marginal(v, shape, [1, 2], ("?", "?", 5, 5)).df


def marginal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six marginals of the events by digits of their ids, from one scan."""
    v, shape = inputs.shaped_event_vector(spark, sf_dir)
    return marginals(v, shape, [[2, 4], [1], [2], [4], [1, 2], []])


def zero_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prune_zeros(inputs.returned_against_accepted(spark, sf_dir)).df


def chain3(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = inputs.nation_operator(spark, sf_dir)
    x = inputs.nation_vector(spark, sf_dir, u.dims[0])
    return chain_apply([u], x, 3).state.df


def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = inputs.nation_operator(spark, sf_dir)
    x = inputs.nation_vector(spark, sf_dir, u.dims[0])
    return chain_apply([compose([u, u, u])], x, 1).state.df


def compose_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to suppliers and back, applied to a vector, as one product: sketches of the
    operators tell that it has to be formed from the right."""
    p = inputs.customer_supplier_counts(spark, sf_dir).store()
    return compose([p, p.transpose(), inputs.customer_vector(spark, sf_dir, p.dims[0])]).entries()


def axis_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation operator found again in ``I (x) operator (x) I``."""
    u = inputs.nation_operator(spark, sf_dir).store()
    found = axis_form(kron(kron(identity(spark, 4), u), identity(spark, 3)))
    outer, _, inner = found.sizes
    return found.matrix.df.select("row", "col", "re", F.lit(outer).alias("outer"), F.lit(inner).alias("inner"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = inputs.nation_operator(spark, sf_dir)
    x = inputs.nation_vector(spark, sf_dir, u.dims[0])
    return chain_apply([u], x, 4, save_every=1).snapshots()


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshots again, kept as changes from step to step."""
    u = inputs.nation_operator(spark, sf_dir)
    x = inputs.nation_vector(spark, sf_dir, u.dims[0])
    return chain_history([u], x, 4, save_every=1).snapshots()


def chain_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to supplier and back, twice, over all order lines."""
    p = inputs.customer_supplier_counts(spark, sf_dir).store()
    x = inputs.customer_vector(spark, sf_dir, p.dims[0])
    return chain_apply([p, p.transpose()], x, 2).state.entries()


def _customer_report(spark: SparkSession, sf_dir: str, measured: Sequence[int] = (2,),
                     position: Sequence[int | str] | None = None) -> dict[str, DataFrame]:
    p = inputs.customer_supplier_counts(spark, sf_dir).store()
    n = inputs.nations(spark, sf_dir)
    rows = inputs.round_up(p.dims[0], n)
    p = replace(p, dims=(rows, p.dims[1]))
    return run([p, p.transpose()], inputs.customer_vector(spark, sf_dir, rows), 1,
               dims=(rows // n, n), measured=measured, position=position)


def chain_marginal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline: chain, squared magnitude, reshape, marginal."""
    return _customer_report(spark, sf_dir)["marginal"]


def chain_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customer_report(spark, sf_dir)["norm"]


def chain_marginal_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's marginal over the first customers of each block of nations."""
    return _customer_report(spark, sf_dir, measured=[1], position=("?", 3))["marginal"]


def chain_componentwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops, lines and returned lines multiplied apart."""
    p = inputs.customer_supplier_counts(spark, sf_dir).store()
    x = inputs.customer_pair_vector(spark, sf_dir, p.dims[0])
    return chain_apply([p, p.transpose()], x, 1, product=COMPONENTWISE).state.entries()


def chain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators and state from text folders, the chain, norm and marginal to text and back."""
    p = inputs.customer_supplier_counts(spark, sf_dir)
    n = inputs.nations(spark, sf_dir)
    rows = inputs.round_up(p.dims[0], n)
    p = replace(p, dims=(rows, p.dims[1])).store()
    folders = [new_folder(spark, "text") for _ in range(5)]
    write_coo(p, folders[0], LEFT)
    write_coo(p.transpose(), folders[1], LEFT)
    write_coo(inputs.customer_vector(spark, sf_dir, rows), folders[2], RIGHT)
    ops = [replace(read_coo(spark, f, LEFT), unique=True) for f in folders[:2]]
    report = run(ops, read_coo(spark, folders[2], RIGHT), 1, dims=(rows // n, n), measured=[2])
    write_norm(report["norm"], folders[3])
    write_tensor(TensorTable(report["marginal"], (n,), ("i2",)), folders[4], RIGHT)
    marginals = read_tensor(spark, folders[4], RIGHT).df.select(
        F.col("i1").alias("i2"), "val", F.lit("marginal").alias("report"))
    total = read_norm(spark, folders[3]).select(
        F.lit(-1).cast("bigint").alias("i2"), F.col("norm").alias("val"), F.lit("norm").alias("report"))
    return marginals.unionByName(total)


def _cells(spark: SparkSession, sf_dir: str) -> tuple[CooTable, CooTable]:
    """Operands of the plans for large data: stored, so that no size bound is known."""
    a = inputs.customer_supplier(spark, sf_dir).store()
    b = inputs.supplier_line(spark, sf_dir, a.dims[1]).store()
    return replace(a, unique=False), replace(b, unique=False)


def matmul_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product by the plan that cuts hot keys into cells, with small cells."""
    a, b = _cells(spark, sf_dir)
    return matmul(a, b, hot=50, plan="cells").entries()


def apply_on_axis_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v, outer = _nation_axis(spark, sf_dir)
    return apply_on_axis(u, v, (outer, u.dims[1]), 2, hot=100, plan="cells").df


def kron_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Kronecker product by blocks of both sides."""
    return kron(inputs.region_nation(spark, sf_dir), inputs.supplier_line(spark, sf_dir),
                block=100, plan="blocks").entries()


def matvec_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operator bucketed by its join index stays where it is; the vector moves."""
    a = store_bucketed(inputs.customer_supplier(spark, sf_dir))
    return matmul(a, inputs.supplier_vector(spark, sf_dir, a.dims[1]), plan="in_place").entries()


def chain_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops and back with bucketed operators that stay in place."""
    p = inputs.customer_supplier_counts(spark, sf_dir).store()
    ops = [store_bucketed(op) for op in (p, p.transpose())]
    x = inputs.customer_vector(spark, sf_dir, p.dims[0])
    return chain_apply(ops, x, 2, plan="in_place").state.entries()


def chain_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops and back with operators whose heavier columns are stored apart."""
    p = inputs.customer_supplier_counts(spark, sf_dir).store()
    ops = [store_split(op, hot=op.count() // op.dims[1]) for op in (p, p.transpose())]
    return chain_apply(ops, inputs.customer_vector(spark, sf_dir, p.dims[0]), 2).state.entries()


def _nation_axis(spark: SparkSession, sf_dir: str) -> tuple[CooTable, CooTable, int]:
    u = inputs.nation_operator(spark, sf_dir)
    rows = inputs.round_up(inputs.events(spark, sf_dir), u.dims[0])
    return u, inputs.event_vector(spark, sf_dir, rows), rows // u.dims[0]


def axis_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v, outer = _nation_axis(spark, sf_dir)
    return apply_on_axis(u, v, (outer, u.dims[1]), 2).df


def axis_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v, outer = _nation_axis(spark, sf_dir)
    return chain_apply([AxisOperator(u, (outer, u.dims[1]), 2)], v, 2).state.df


def kron_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v, outer = _nation_axis(spark, sf_dir)
    return matmul(kron(identity(spark, outer), u), v).df


def _power_of_two_events(spark: SparkSession, sf_dir: str) -> CooTable:
    n = inputs.events(spark, sf_dir)
    return inputs.event_vector(spark, sf_dir, 1 << (n - 1).bit_length())


def _odd_user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "events").where("user_id % 2 = 1").select(
        F.col("event_id").alias("row"))


def reflect_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values reflected at their mean, those of odd users negated before."""
    return reflect(_power_of_two_events(spark, sf_dir), _odd_user_events(spark, sf_dir)).df


def reflect_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    flipped = _odd_user_events(spark, sf_dir)
    return reflect(reflect(_power_of_two_events(spark, sf_dir), flipped), flipped).df


def reflect_iterated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five reflections as one plan."""
    return iterate_reflect(_power_of_two_events(spark, sf_dir), 5,
                           _odd_user_events(spark, sf_dir)).df


def shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's value taken from three events on."""
    v = inputs.event_vector(spark, sf_dir)
    return matmul(cyclic_shift(spark, (v.dims[0],), (3,)), v).df


def shift_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values on a square, moved by one along and two back across."""
    side = math.isqrt(inputs.events(spark, sf_dir) - 1) + 1
    return matmul(cyclic_shift(spark, (side, side), (1, -2)),
                  inputs.event_vector(spark, sf_dir, side * side)).df


def identity_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = inputs.customer_supplier(spark, sf_dir, merge=False)
    return matmul(identity(spark, a.dims[0]), a).entries()


def uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row sums weighted by the uniform vector over a power of four columns."""
    cols = 1
    while cols < inputs.suppliers(spark, sf_dir):
        cols *= 4
    return matmul(inputs.customer_supplier(spark, sf_dir, cols, merge=False),
                  uniform_vector(spark, cols)).entries()


def basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two suppliers' columns combined by a sparse vector."""
    half = inputs.round_up(inputs.suppliers(spark, sf_dir), 2) // 2
    e = basis_vector(spark, (2, half), {(0, 1): 1, (1, 0): -2 + 1j})
    return matmul(inputs.customer_supplier(spark, sf_dir, 2 * half, merge=False), e).entries()


def complex_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.floor("value").cast("string"), F.lit("j-"), F.col("user_id").cast("string"))
    re, im = parse_complex(F.col("text"))
    return inputs.table(spark, sf_dir, "events").select("event_id", text.alias("text")).select(
        "event_id", re.alias("re"), im.alias("im"))


def coo_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrix to text lines and back."""
    return parse_coo(format_coo(inputs.customer_supplier(spark, sf_dir), LEFT), LEFT)


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both operands of a product through text files in two folders: one read for the
    headers of both, one for each operand."""
    left, right = new_folder(spark, "text"), new_folder(spark, "text")
    write_coo(inputs.customer_supplier(spark, sf_dir), left, LEFT)
    write_coo(inputs.supplier_line(spark, sf_dir), right, RIGHT)
    both = [left, right]
    dims = read_headers(spark, both)
    return matmul(*(read_coo(spark, both, role, dims[role]) for role in (LEFT, RIGHT))).entries()


def text_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same product, written and read by the data source of the text format."""
    left, right = new_folder(spark, "text"), new_folder(spark, "text")
    save_coo(inputs.customer_supplier(spark, sf_dir), left, LEFT)
    save_coo(inputs.supplier_line(spark, sf_dir), right, RIGHT)
    return matmul(load_coo(spark, left, LEFT), load_coo(spark, right, RIGHT)).entries()


def tensor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "text")
    write_tensor(_event_array(spark, sf_dir), path, RIGHT)
    return sum_axis(read_tensor(spark, path, RIGHT), [1, 3]).df


def parquet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "matrix")
    write_parquet(inputs.customer_supplier(spark, sf_dir), path)
    a = read_parquet(spark, path)
    return matmul(a, inputs.supplier_vector(spark, sf_dir, a.dims[1])).entries()


def out_of_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries outside a matrix declared half as tall and half as wide."""
    a = inputs.customer_supplier(spark, sf_dir)
    halved = tuple(inputs.round_up(d, 2) // 2 for d in a.dims)
    return check_bounds(CooTable(a.df, halved))


QUERIES: dict[str, Query] = {
    "coo_build": coo_build,
    "dims": dims,
    "matmul_complex": matmul_complex,
    "matmul_componentwise": matmul_componentwise,
    "matvec": matvec,
    "matvec_bucketed": matvec_bucketed,
    "gram": gram,
    "cooccurrence": cooccurrence,
    "kron": kron_complex,
    "kron_componentwise": kron_componentwise,
    "norm": frobenius_norm,
    "norm_exact": norm_exact,
    "abs_square": squared_magnitude,
    "reshape": reshape_vector,
    "ravel": ravel_array,
    "sum_axis": sum_two_axes,
    "sum_axis_exact": sum_axis_exact,
    "sum_axis_all": sum_all_axes,
    "sum_axis_fixed": sum_axis_fixed,
    "sum_axis_leading": sum_axis_leading,
    "marginal": event_marginal,
    "marginal_fixed": marginal_fixed,
    "marginal_sets": marginal_sets,
    "zero_prune": zero_prune,
    "chain3": chain3,
    "compose": composed,
    "compose_ordered": compose_ordered,
    "axis_form": axis_found,
    "snapshots": snapshots,
    "history": history,
    "chain_hops": chain_hops,
    "chain_marginal": chain_marginal,
    "chain_norm": chain_norm,
    "chain_marginal_fixed": chain_marginal_fixed,
    "chain_componentwise": chain_componentwise,
    "chain_text": chain_text,
    "matmul_cells": matmul_cells,
    "apply_on_axis_cells": apply_on_axis_cells,
    "kron_blocks": kron_blocks,
    "matvec_in_place": matvec_in_place,
    "chain_in_place": chain_in_place,
    "chain_split": chain_split,
    "axis_apply": axis_apply,
    "axis_chain": axis_chain,
    "kron_apply": kron_apply,
    "reflect1": reflect_once,
    "reflect2": reflect_twice,
    "reflect_iterated": reflect_iterated,
    "shift": shift,
    "shift_2d": shift_2d,
    "identity": identity_product,
    "uniform": uniform,
    "basis_vector": basis,
    "parse_complex": complex_text,
    "coo_text": coo_text,
    "text_files": text_files,
    "text_source": text_source,
    "tensor_files": tensor_files,
    "parquet_files": parquet_files,
    "check_bounds": out_of_bounds,
}
