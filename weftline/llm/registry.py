"""Queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from weftline.llm import ann, bpe, centroids, langid, licenses, mixing, neardup, quality, secrets, shingles, urlrules, whitening, wrappers

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_langid": langid.op2_langid,
    "op3_ann": ann.op3_ann,
    "op4_bpe": bpe.op4_bpe,
    "op5_quality": quality.op5_quality,
    "op6_jaccard": shingles.op6_jaccard,
    "op7_html": wrappers.op7_html,
    "op8_neardup": neardup.op8_neardup,
    "op9_urls": urlrules.op9_urls,
    "op10_secrets": secrets.op10_secrets,
    "op11_whitening": whitening.op11_whitening,
    "op12_centroids": centroids.op12_centroids,
    "op13_licenses": licenses.op13_licenses,
}

ORACLE_SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op8_neardup": neardup.OP8_SQL,
    "op9_urls": urlrules.OP9_SQL,
    "op10_secrets": secrets.OP10_SQL,
    "op12_centroids": centroids.OP12_SQL,
}
