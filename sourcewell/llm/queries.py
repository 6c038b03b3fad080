"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import documents, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and their groups over whole documents. Null and wordless texts have fingerprint zero and are linked like
    any other; repeated rows stay and share a group; ties don't arise, the smallest id names the group."""
    from .simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of whole documents. Null and empty texts have none; repeated rows are counted each."""
    from .token_counts import token_counts

    return token_counts(documents(spark, sf_dir), tokenizer_path())


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of whole documents, learned from those that may be learned from. Null and letterless texts are 'und';
    equal sizes go to the language with more training documents; a null doc_id has a null held_out and teaches nothing."""
    from .language_id import train_and_identify

    return train_and_identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of whole documents. Null texts are empty; texts under 200 bytes keep all; repeated rows are
    documents of their own, so all of their bytes go if they are long enough."""
    from .suffix_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in whole documents. Null and empty texts have none; repeated rows are scanned each; overlapping kinds are
    listed in their fixed order."""
    from .secrets import report

    return report(documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with benchmark items: doc_id, item_id, coverage, verbatim. Null, empty and wordless texts and items match
    nothing; repeated rows count once; of several occurrences the best is told."""
    from .decontam import leaks

    return leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of whole documents and the text that they decode to, as digests. Null and empty texts have no ids; repeated rows
    are encoded each."""
    from .bpe_codec import round_trip

    return round_trip(documents(spark, sf_dir), tokenizer_path())


def op8_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no media; every vector of embeddings is drawn as an image, each fifth with an edited copy."""
    from .media import copies, media_of

    return copies(media_of(table(spark, sf_dir, "embeddings")))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of whole pages. Null, empty and text-free pages give an empty text; pages repeated on a host count as one
    content there; a null address belongs to the host of pages without one."""
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of whole documents. Null and empty texts are scored by features that are all zero; labels of a document
    that contradict each other count as 0; a null doc_id has a null held_out and teaches nothing."""
    from .quality import train_and_score

    return train_and_score(documents(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all usable vectors. Null, empty and non-finite vectors are dropped; repeated rows are coded each;
    null labels are one label; of equally near entries the lower is taken."""
    from .vector_codes import compress

    return compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repairs of all damaged conversations. Null roles, texts and numbers of the damage are one space; null turns
    come first; equal turns by role and text; repeated rows are duplicates; null conv_ids are one conversation."""
    from .conversations import damage, repair

    return repair(damage(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of all whose vec_id is divisible by 100. Null, empty, zero and non-finite vectors and null ids take
    no part; rows that repeat id and vector count once; of equally near rows the smaller id comes first."""
    from .neighbours import nearest

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 100 = 0"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .oracles import repair_sql, vector_codes_sql

    return {"op11_vector_codes": vector_codes_sql(), "op12_conversation_repair": repair_sql()}
