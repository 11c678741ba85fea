"""The registered queries of this subpackage and their SQL."""

from spanloom.llm import audit, bpe, chat, fim, fingerprints, html, mixing, neardup, quality, suffixes, urls, vectors, warc

QUERIES = {
    f.__name__: f
    for f in (
        chat.op1_chat_format,
        warc.op2_warc,
        mixing.op3_mix_sources,
        html.op4_html_extract,
        quality.op5_quality_rules,
        neardup.op6_ngram_jaccard,
        vectors.op7_embedding_dedup,
        urls.op8_url_filters,
        suffixes.op9_suffix_dedup,
        bpe.op10_byte_bpe,
        fingerprints.op11_fingerprints,
        audit.op12_source_divergence,
        fim.op13_fill_in_middle,
    )
}

SQL = {
    "op1_chat_format": chat.OP1_SQL,
    "op2_warc": warc.OP2_SQL,
    "op8_url_filters": urls.OP8_SQL,
    "op12_source_divergence": audit.OP12_SQL,
    "op13_fill_in_middle": fim.OP13_SQL,
}
