"""Token counts: pieces are counted once per distinct pre-token.

1. Blocks of documents number their distinct pre-tokens and keep each document's frequencies
   (``blocks``).
2. Requests for the same pre-token meet; it is encoded once and only the length is kept.
3. The lengths return to the blocks that asked; a document's count is the sum of frequency
   times length.  No ids of a document are ever made.

Cases: null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows give
repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodeframe.llm import vocab
from lodeframe.llm.blocks import answer, by_token, lists, write_blocks
from lodeframe.llm.texts import id_and_text, sums_by

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``)."""
    requests, folder = write_blocks(id_and_text(docs, id_col, text_col), vocab.pre_tokens(tokenizer))

    def pieces(tokens: list[bytes], _: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {"pieces": vocab.encode(tokenizer, tokens)[1].astype(np.int32)}

    def finish(batch: pa.RecordBatch, values: dict[str, np.ndarray]) -> pa.Table:
        ids, freqs, offsets = lists(batch)
        n = sums_by(values["pieces"][ids] * freqs.astype(np.int64), offsets) if len(ids) else np.zeros(batch.num_rows, np.int64)
        return pa.table({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    return answer(by_token(requests).select("ref", "token"), folder, pieces, finish, SCHEMA)
