"""Corpus pipeline: from documents to encoded text, one operator after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written
as Parquet and read again as the next one's docs. All but the last return the columns of
documents. Rows with nulls, empty or very long texts, repeated rows and additional
columns go through; an empty table gives an empty result.
"""

import uuid

from lavka.llm import exact_dedup, language_id, mixing, sentencepiece_codec, simhash_dedup
from lavka.llm.queries import tokenizer_file
from lavka.llm.tables import table
from lavka.session import shared_dir


def identify_language(spark, docs, sf_dir):
    """Keeps documents that have a language: texts without a letter go."""
    return language_id.keep_identified(docs)


def drop_exact_copies(spark, docs, sf_dir):
    """Keeps one document of each text (A-Z as a-z), the one with the largest id."""
    return exact_dedup.drop_exact_copies(docs, keep="max")


def drop_near_copies(spark, docs, sf_dir):
    """Keeps one document of each SimHash component, the one with the smallest id."""
    return simhash_dedup.drop_near_copies(docs)


def mix_sources(spark, docs, sf_dir):
    """Takes documents by the sources' target weights: some twice, some not; see mixing.mixed_documents."""
    return mixing.mixed_documents(docs, length_col="n_chars")


def encode_pieces(spark, docs, sf_dir):
    """Encodes every text and decodes it again: doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32.

    A document that the mix took twice has two rows.
    """
    return sentencepiece_codec.round_trips(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

# A trained classifier and an encoder are not said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages applied to documents, each written to the shared folder and read again."""
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        rows = stage(spark, docs, sf_dir)
        rows.write.parquet(f"{folder}/{i}")
        docs = spark.read.schema(rows.schema).parquet(f"{folder}/{i}")
    return docs
