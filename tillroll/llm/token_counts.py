"""Token counts with a shortcut for pre-tokens that are whole tokens."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from tillroll.llm.common import map_rows

TOKENIZER = "byte_bpe_50k.json"
MEMO_ENTRIES = 300_000

# White space as Python sees it takes in all that the tokenizer treats as such, so
# a cut at a lone blank between two other characters is a pre-token boundary.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_NOT_PLAIN = re.compile(r"\s\s|\A\s|\s\Z")


def load_tokenizer(path: str | None, name: str):
    """Open a tokenizer file; without a path, the public one of that name."""
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    return Tokenizer.from_file(str(path))


def whole_tokens(tokenizer) -> frozenset[str]:
    """Vocabulary strings that, met alone as a pre-token, become that one token.

    A string is in the vocabulary because some merge makes it, but merging in rank
    order may never reach it. Each one is therefore encoded once, ahead of the job.
    """
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    model = tokenizer.model
    return frozenset(
        text
        for text in tokenizer.get_vocab(with_added_tokens=True)
        if text not in special and [t.value for t in model.tokenize(text)] == [text]
    )


class PretokenCounter:
    """Counts a text's tokens; remembers stretches between blanks it has seen."""

    def __init__(self, tokenizer, whole: frozenset[str], entries: int = MEMO_ENTRIES):
        self._pretokens = tokenizer.pre_tokenizer.pre_tokenize_str
        self._merge = tokenizer.model.tokenize
        self._whole = whole
        self._special = sorted(
            (t.content for t in tokenizer.get_added_tokens_decoder().values()),
            key=len,
            reverse=True,
        )
        self._split = re.compile("|".join(map(re.escape, self._special)) or r"(?!)")
        self._entries = entries
        self._memo: dict[str, int] = {}

    def _stretch(self, text: str) -> int:
        whole, merge = self._whole, self._merge
        return sum(
            1 if token in whole else len(merge(token)) for token, _ in self._pretokens(text)
        )

    def _plain(self, text: str) -> int:
        if _NOT_PLAIN.search(text):
            parts = _CUT.split(text)
        else:
            first, *rest = text.split(" ")
            parts = [first, *[f" {word}" for word in rest]]
        memo = self._memo
        try:
            return sum(map(memo.__getitem__, parts))
        except KeyError:
            pass
        total = 0
        for part in parts:
            count = memo.get(part)
            if count is None:
                if len(memo) >= self._entries:
                    memo.clear()
                count = self._stretch(part)
                if len(part) <= 64:
                    memo[part] = count
            total += count
        return total

    def count(self, text: str) -> int:
        if not any(s in text for s in self._special):
            return self._plain(text) if text else 0
        found = self._split.findall(text)
        return len(found) + sum(self._plain(p) for p in self._split.split(text) if p)


def token_counts(
    docs: DataFrame,
    limit: int = 512,
    tokenizer_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokens of every whole text, as the tokenizer library counts them.

    The vocabulary is proved once on the driver: the set of strings that encode
    alone as one token, bounded by the vocabulary, goes to the workers. There, a
    pre-token in that set counts one; only the others are merged. Special strings
    inside a text are one token each; none are added.

    One row per input row, repeats included: ``id_col``, ``n_bytes``, ``n_tokens``,
    ``over_limit``. A null text counts as empty, with no tokens. Other columns are
    not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    proved = spark.sparkContext.broadcast(whole_tokens(load_tokenizer(tokenizer_path, TOKENIZER)))

    def start():
        counter = PretokenCounter(load_tokenizer(tokenizer_path, TOKENIZER), proved.value)

        def row(key, text):
            text = text or ""
            return key, len(text.encode()), counter.count(text)

        return row

    kind = docs.schema[id_col].dataType.simpleString()
    counted = map_rows(
        docs, [id_col, text_col], start, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
