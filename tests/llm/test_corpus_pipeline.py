import hashlib
import re
from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline
from lavka.llm import language_id
from lavka.llm.tables import table
from tests.llm.test_exact_dedup import lower_ascii
from tests.llm.test_mixing import brute_targets
from tests.llm.test_simhash_dedup import brute_components, plain_fingerprint

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, model):
    """Rows of the pipeline by plain Python, given the language model: {(doc_id, decoded text): copies}."""
    rows = [r for r in rows if (p := language_id.predict_text(r.text, model))[0] != "und" and p[1] >= 0.3]
    last = {}
    for r in rows:
        key = lower_ascii(r.text)
        last[key] = max(last.get(key, r), r, key=lambda r: r.doc_id)
    rows = list(last.values())
    group = brute_components({r.doc_id: plain_fingerprint(r.text) for r in rows})
    rows = [r for r in rows if group[r.doc_id] == r.doc_id]
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(WORD.findall(r.text)) for r in rows if r.source == s) for s in sources]
    out = Counter()
    for source, size, target in zip(sources, sizes, brute_targets(sizes), strict=True):
        stream = sorted((r for r in rows if r.source == source),
                        key=lambda r: (hashlib.md5(f"{r.doc_id}:7".encode()).hexdigest(), r.doc_id))
        at, quota = 0, int(target)
        for epoch in range(2):
            at = epoch * size
            for r in stream:
                words = WORD.findall(r.text)
                taken = max(0, min(len(words), quota - at))
                at += len(words)
                if taken:
                    out[r.doc_id, r.text if taken == len(words) else " ".join(words[:taken])] += 1
    return out


def test_run_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    model = language_id.learn(docs.where(~language_id.held_out(docs["doc_id"])))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = Counter()
    for (doc_id, text), copies in brute(docs.collect(), model).items():
        ids = [*library.encode(text), library.eos_id()]
        expected[doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                 hashlib.sha256(library.decode(ids).encode()).hexdigest()] += copies
    found = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == expected


def test_stages_return_the_columns_of_their_input(spark, awkward, empty):
    for docs in (awkward, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, docs, SF)
            assert left.columns == docs.columns, name
            docs = spark.createDataFrame(left.collect(), docs.schema)
        rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert len(rows) == docs.count()


def test_clean_documents_stay(spark):
    """Language ID and both kinds of dedup leave alone what is neither junk nor a copy."""
    docs = table(spark, SF, "documents")
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, SF).collect()}
    clean = {r.doc_id for r in docs.collect() if language_id.has_letter(r.text) and len(r.text) > 200}
    assert len(clean - kept) <= 0.01 * len(clean)
