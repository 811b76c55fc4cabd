"""Point lookups on an index: predicates on sorted tables; misses give None, -1, 0 or nothing, as documented."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.operators.index import ReviewIndex


class IndexReader:
    """Single lookups for interactive use; batches join the tables instead."""

    def __init__(self, index: ReviewIndex) -> None:
        self.index = index

    def _one(self, table: DataFrame, key: str, value: object, column: str, miss: object) -> object:
        row = table.where(F.col(key) == F.lit(value)).select(column).first()
        return miss if row is None else row[0]

    def get_product_id(self, doc_id: int) -> str | None:
        return self._one(self.index.reviews, "doc_id", doc_id, "product_id", None)

    def get_review_score(self, doc_id: int) -> int:
        return self._one(self.index.reviews, "doc_id", doc_id, "score", -1)

    def get_review_helpfulness_numerator(self, doc_id: int) -> int:
        return self._one(self.index.reviews, "doc_id", doc_id, "helpfulness_num", -1)

    def get_review_helpfulness_denominator(self, doc_id: int) -> int:
        return self._one(self.index.reviews, "doc_id", doc_id, "helpfulness_den", -1)

    def get_review_length(self, doc_id: int) -> int:
        return self._one(self.index.reviews, "doc_id", doc_id, "num_tokens", -1)

    def get_token_frequency(self, token: str) -> int:
        """Reviews that hold the token (not tokenized, only lower-cased)."""
        return self._one(self.index.dictionary, "term", token.lower(), "df", 0)

    def get_token_collection_frequency(self, token: str) -> int:
        return self._one(self.index.dictionary, "term", token.lower(), "cf", 0)

    def get_reviews_with_token(self, token: str) -> DataFrame:
        """(doc_id, tf), doc_id ascending."""
        return self.index.postings.where(F.col("term") == token.lower()).select("doc_id", "tf").orderBy("doc_id")

    def get_product_reviews(self, product_id: str) -> DataFrame:
        """(doc_id), ascending. The product's first and last doc_id narrow the scan of the reviews, which are sorted by it."""
        key = F.col("product_id") == product_id.strip().upper()
        ends = self.index.products.where(key).select("min_doc_id", "max_doc_id").first()
        return self.index.reviews.where(key & F.col("doc_id").between(*(ends or (0, -1)))).select("doc_id").orderBy("doc_id")

    def get_number_of_reviews(self) -> int:
        return self.index.stats.first()["num_reviews"]

    def get_token_size_of_reviews(self) -> int:
        return self.index.stats.first()["total_tokens"]

    def get_unique_number_of_tokens(self) -> int:
        return self.index.stats.first()["unique_terms"]

    def get_index_of_token(self, token: str) -> int:
        """0-based place in byte order; for a missing token, minus (the place where it belongs) minus 1."""
        at = self._one(self.index.dictionary, "term", token.lower(), "term_index", -1)
        return at if at >= 0 else -self.index.dictionary.where(F.col("term") < token.lower()).count() - 1

    def get_term(self, term_index: int) -> str | None:
        """The term with a number of get_index_of_token(); None where no term has it."""
        return self._one(self.index.dictionary, "term_index", term_index, "term", None)

    def get_token_frequency_at(self, term_index: int) -> int:
        return self._one(self.index.dictionary, "term_index", term_index, "df", 0)

    def get_token_collection_frequency_at(self, term_index: int) -> int:
        return self._one(self.index.dictionary, "term_index", term_index, "cf", 0)

    def get_doc_ids_and_freqs(self, term_index: int) -> DataFrame:
        """(doc_id, tf) of the term with a number, doc_id ascending."""
        return self.get_reviews_with_token(self.get_term(term_index) or "")

    def terms(self) -> DataFrame:
        return self.index.dictionary.orderBy("term")

    def tokens(self) -> DataFrame:
        return self.index.postings.select("term", "doc_id", "tf").orderBy("term", "doc_id")
