"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP5_SQL, op5_budgeted_windows
from .decontaminate import OP8_SQL, op8_winnowing
from .langid import op3_ftrl_langid
from .mixing import OP6_SQL, op6_pareto_mixing
from .nbsvm import op7_naive_bayes_svm
from .nnpu import op2_nn_pu
from .paragraphs import op10_paragraph_minhash
from .periodic import op12_harmonic_grid_runs
from .quality_rules import op1_compression_bands
from .sharding import OP9_SQL, op9_prefix_sum_shards
from .simhash import op4_simhash_bktree
from .url_rules import OP11_SQL, op11_redirect_equivalence
from .whitening import op13_chan_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_compression_bands": op1_compression_bands,
    "op2_nn_pu": op2_nn_pu,
    "op3_ftrl_langid": op3_ftrl_langid,
    "op4_simhash_bktree": op4_simhash_bktree,
    "op5_budgeted_windows": op5_budgeted_windows,
    "op6_pareto_mixing": op6_pareto_mixing,
    "op7_naive_bayes_svm": op7_naive_bayes_svm,
    "op8_winnowing": op8_winnowing,
    "op9_prefix_sum_shards": op9_prefix_sum_shards,
    "op10_paragraph_minhash": op10_paragraph_minhash,
    "op11_redirect_equivalence": op11_redirect_equivalence,
    "op12_harmonic_grid_runs": op12_harmonic_grid_runs,
    "op13_chan_whitening": op13_chan_whitening,
}

#: DuckDB SQL of the queries that SQL can express; the others are tested against brute force.
ORACLES: dict[str, str] = {"op5_budgeted_windows": OP5_SQL, "op6_pareto_mixing": OP6_SQL, "op8_winnowing": OP8_SQL, "op9_prefix_sum_shards": OP9_SQL, "op11_redirect_equivalence": OP11_SQL}
