"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from loamline.llm.clustering import OP12_SQL, op12_centroid_clustering
from loamline.llm.decontaminate import OP10_SQL, op10_decontaminate
from loamline.llm.jaccard_join import OP2_SQL, op2_jaccard_join
from loamline.llm.lexical_search import OP13_SQL, op13_lexical_search
from loamline.llm.licenses import OP3_SQL, op3_licenses
from loamline.llm.mixing import op5_mixing
from loamline.llm.lm_scoring import op1_lm_scoring
from loamline.llm.quality import op6_quality
from loamline.llm.quality_classifier import op11_quality_classifier
from loamline.llm.suffix_array import OP7_SQL, op7_suffix_array
from loamline.llm.suffix_tree import OP8_SQL, op8_suffix_tree
from loamline.llm.toxicity import op4_toxicity
from loamline.llm.warc import OP9_SQL, op9_warc

QUERIES = {
    "op2_jaccard_join": op2_jaccard_join,
    "op3_licenses": op3_licenses,
    "op5_mixing": op5_mixing,
    "op1_lm_scoring": op1_lm_scoring,
    "op4_toxicity": op4_toxicity,
    "op6_quality": op6_quality,
    "op7_suffix_array": op7_suffix_array,
    "op8_suffix_tree": op8_suffix_tree,
    "op9_warc": op9_warc,
    "op10_decontaminate": op10_decontaminate,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_lexical_search": op13_lexical_search,
}
ORACLE_SQL = {
    "op2_jaccard_join": OP2_SQL,
    "op7_suffix_array": OP7_SQL,
    "op8_suffix_tree": OP8_SQL,
    "op3_licenses": OP3_SQL,
    "op9_warc": OP9_SQL,
    "op10_decontaminate": OP10_SQL,
    "op12_centroid_clustering": OP12_SQL,
    "op13_lexical_search": OP13_SQL,
}
