"""Subword vocabularies and masked-language-model examples.

Training reduces the corpus to a table of distinct pieces with counts (the only
corpus-sized step); merges are then learned by pair counts over that table.
Encoding is row-local over Arrow batches and splits each distinct piece of a
batch once.  Masking is an array expression keyed by hashes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wordloom.functions import text as tx
from wordloom.functions.arrays import attention_mask, fit_array
from wordloom.functions.keys import KEY_BITS, hash_key
from wordloom.operators import rounds, unigram
from wordloom.operators.merging import FlatPieces, SideBySide, replayer
from wordloom.operators.ordering import global_position
from wordloom.session import checkpointed, local_table

# --- fixed values ------------------------------------------------------------------------
SPECIAL_TOKENS = ("<s>", "</s>", "<mask>", "<pad>", "<unk>", "<cls>")
N_EXTRA_IDS = 100
BOUNDARY = "▁"
CONTINUATION = "##"
UNKNOWN = ("<unk>", "[UNK]")
BYTE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FAMILY_OF = {
    "BPE": "bpe",
    "WordPiece": "wordpiece",
    "SentencePiece": "sentencepiece",
    "ByteLevelBPE": "bytes",
    "roberta-base": "bytes",
    "bert-base-uncased": "wordpiece",
    "Unigram": "unigram",
    "t5-base": "unigram",
    "albert-base-v2": "unigram",
}
LOWERED = ("bert-base-uncased", "albert-base-v2")
IGNORED_LABEL = -100
# -------------------------------------------------------------------------------------------
SEP = "\u0001"  # between the symbols of a piece
MEMO = 200_000  # pieces whose tokens a task remembers
AT_ONCE = 16_384  # pieces that are split side by side
LOCAL_SYMBOLS = 4_000_000  # pieces of so many symbols together (16 MB) are merged on the driver


@dataclass(frozen=True)
class Subwords:
    """A trained subword vocabulary."""

    family: str
    vocab: DataFrame  # token, id, and for the unigram family score
    merges: DataFrame  # rank, left, right, merged; none in the unigram family
    words: DataFrame  # piece, frequency, tokens


def family_of(name: str) -> str:
    return FAMILY_OF.get(name, name)


def special_tokens(spark: SparkSession) -> DataFrame:
    """token, id of the reserved tokens, which take the first ids."""
    tokens = list(SPECIAL_TOKENS) + [f"<extra_id_{i}>" for i in range(N_EXTRA_IDS)]
    return local_table(spark, [(t, i) for i, t in enumerate(tokens)], "token string, id bigint")


# --- pieces and symbols ----------------------------------------------------------------------
def text_pieces(text: Column | str, family: str) -> Column:
    """The pieces merges may not cross, per family."""
    c = F.replace(F.col(text) if isinstance(text, str) else text, F.lit(SEP), F.lit("�"))
    if family == "bytes":
        return F.regexp_extract_all(c, F.lit(BYTE_PIECES), F.lit(0))
    if family in ("sentencepiece", "unigram"):
        words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
        return F.transform(words, lambda w: F.concat(F.lit(BOUNDARY), w))
    return tx.pre_tokens(c)


def pretokenize(df: DataFrame, text: str = "text", family: str = "bpe") -> DataFrame:
    """piece, frequency."""
    pieces = df.select(F.explode(text_pieces(text, family)).alias("piece"))
    return pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("frequency"))


def start_symbols(piece: Column | str, family: str) -> Column:
    """Symbols of a piece as one string, a separator around each."""
    c = F.col(piece) if isinstance(piece, str) else piece
    if family == "bytes":
        inner = F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "$1" + SEP)
    elif family == "wordpiece":
        rest = F.regexp_replace(F.substring(c, 2, 2**31 - 1), r"(?s)(.)", CONTINUATION + "$1" + SEP)
        inner = F.concat(F.substring(c, 1, 1), F.lit(SEP), rest)
    else:
        inner = F.regexp_replace(c, r"(?s)(.)", "$1" + SEP)
    return F.concat(F.lit(SEP), inner)


def symbol_array(symbols: Column | str) -> Column:
    c = F.col(symbols) if isinstance(symbols, str) else symbols
    return F.filter(F.split(c, SEP), lambda s: s != "")


def pair_counts(words: DataFrame, symbols: str = "symbols", weight: str = "frequency") -> DataFrame:
    """left, right, count of adjacent symbols, weighted by piece frequency."""
    arrays = words.select(symbol_array(symbols).alias("_s"), weight)
    last = F.size("_s") - 2
    none = F.array().cast("array<int>")
    spots = F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(none)).alias("_i")
    pairs = arrays.select("_s", weight, spots).select(
        F.get("_s", F.col("_i")).alias("left"), F.get("_s", F.col("_i") + 1).alias("right"), weight
    )
    return pairs.groupBy("left", "right").agg(F.sum(weight).alias("count"))


def symbol_counts(words: DataFrame, symbols: str = "symbols", weight: str = "frequency") -> DataFrame:
    rows = words.select(F.explode(symbol_array(symbols)).alias("symbol"), weight)
    return rows.groupBy("symbol").agg(F.sum(weight).alias("count"))


def pair_scores(words: DataFrame) -> DataFrame:
    """left, right, count, score = count / (count of left * count of right)."""
    single = symbol_counts(words)
    left = single.select(F.col("symbol").alias("left"), F.col("count").alias("_l"))
    right = single.select(F.col("symbol").alias("right"), F.col("count").alias("_r"))
    pairs = pair_counts(words).join(left, "left").join(right, "right")
    return pairs.select("left", "right", "count", (F.col("count") / (F.col("_l").cast("double") * F.col("_r"))).alias("score"))


def _merged(left: str, right: str) -> str:
    return left + right.removeprefix(CONTINUATION)


def _symbol_rows(words: DataFrame):
    """Symbols and frequency of each piece, through Arrow."""
    for batch in words.select("symbols", "frequency").toArrow().to_batches():
        for symbols, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield [s for s in symbols.split(SEP) if s], n


def _split_symbols(symbols: str) -> list[str]:
    return [s for s in symbols.split(SEP) if s]


def _replayed(merges: list[tuple[int, str, str, str]]):
    """Column function: start symbols of a piece to its tokens after ``merges``."""
    replay = replayer(merges)

    @F.pandas_udf("array<string>")
    def tokens(rows):
        return rows.map(lambda symbols: replay([s for s in symbols.split(SEP) if s]))

    return tokens


def train_tokenizer(
    df: DataFrame, text: str = "text", family: str = "bpe", vocab_size: int = 30_000,
    min_frequency: int = 1, cut_every: int = 8, score: str | None = None, local_symbols: int = LOCAL_SYMBOLS,
) -> Subwords:
    """Learn merges until the vocabulary is full or no pair is frequent enough.

    The order is the greedy one: best first, ties by symbols.  The distinct pieces
    are counted first: up to ``local_symbols`` symbols they are merged on the driver.
    Beyond, they stay distributed and the driver sees the regions around the best
    pairs (``rounds``).  ``score`` is "count" (the default) or "likelihood" (count over
    the product of both symbols' counts), of which the driver holds all counts and sees
    the pieces with the best pairs.  All ways give the same merges.  The unigram family has
    no merges; it is learned by ``unigram``.
    """
    lowered = family in LOWERED
    family = family_of(family)
    wordpiece = family == "wordpiece"
    likelihood = score == "likelihood"
    spark = df.sparkSession
    if lowered:
        df = df.select(F.lower(text).alias(text))
    if family == "unigram":
        return _train_unigram(pretokenize(df, text, family), vocab_size)
    words = pretokenize(df, text, family).withColumn("symbols", start_symbols("piece", family))
    words = checkpointed(words)
    specials = special_tokens(spark)
    symbols = words.select(F.explode(symbol_array("symbols")).alias("token"))
    if family == "bytes":  # every byte, also those not seen
        symbols = symbols.unionByName(spark.range(256).select(F.lpad(F.hex("id"), 2, "0").alias("token")))
    alphabet = checkpointed(global_position(symbols.distinct(), ["token"], "pos"))
    n_special = specials.count()
    n_alphabet = alphabet.count()
    room = vocab_size - n_special - n_alphabet
    merge = _merged if wordpiece else (lambda left, right: left + right)
    merges: list[tuple[int, str, str, str]] = []
    n_symbols = words.agg(F.sum(F.size(symbol_array("symbols")) + 1)).first()[0] or 0
    local = room > 0 and n_symbols <= local_symbols
    spread = room > 0 and not local
    if local:
        merges = FlatPieces(_symbol_rows(words), likelihood, min_frequency).train(room, merge)
    elif spread:
        names = [r["token"] for r in alphabet.orderBy("pos").collect()]
        pieces = rounds.numbered(words, _split_symbols, {s: k for k, s in enumerate(names)})
        if likelihood:
            pieces, merges = rounds.train_likelihood(pieces, names, room, merge, min_frequency, rewrite_every=cut_every)
        else:
            pieces, merges = rounds.train(pieces, names, room, merge, min_frequency)
    merge_rows = local_table(spark, merges, "rank bigint, left string, right string, merged string")
    made = merge_rows.groupBy("merged").agg(F.min("rank").alias("rank"))
    made = global_position(made, ["rank"], "pos")
    vocab = specials.unionByName(alphabet.select("token", (F.col("pos") + n_special).alias("id"))).unionByName(
        made.select(F.col("merged").alias("token"), (F.col("pos") + n_special + n_alphabet).alias("id"))
    )
    vocab = vocab.groupBy("token").agg(F.min("id").alias("id"))
    if spread:
        return Subwords(family, vocab, merge_rows, rounds.named(pieces, names))
    tokens = _replayed(merges)("symbols") if local else symbol_array("symbols")
    return Subwords(family, vocab, merge_rows, words.select("piece", "frequency", tokens.alias("tokens")))


def _train_unigram(pieces: DataFrame, vocab_size: int) -> Subwords:
    spark = pieces.sparkSession
    pieces = checkpointed(pieces)
    specials = special_tokens(spark)
    first = specials.count()
    scores = unigram.train(pieces, max(0, vocab_size - first))
    order = sorted(scores, key=lambda t: (-scores[t], t))
    learned = local_table(spark, [(t, first + k, scores[t]) for k, t in enumerate(order)], "token string, id bigint, score double")
    vocab = learned.unionByName(specials, allowMissingColumns=True).groupBy("token").agg(F.min_by("score", "id").alias("score"), F.min("id").alias("id"))
    model = Subwords("unigram", vocab, local_table(spark, [], "rank bigint, left string, right string, merged string"), pieces)
    tokens = token_splitter(model)(F.array("piece"))
    return Subwords("unigram", vocab, model.merges, pieces.select("piece", "frequency", tokens.alias("tokens")))


def cut_to(model: Subwords, vocab_size: int) -> Subwords:
    """The vocabulary that training to a smaller size gives: greedy merges are a prefix of
    more greedy merges.  ``words`` are encoded anew.  Not for the unigram family."""
    if model.family == "unigram":
        raise ValueError("a smaller unigram vocabulary is trained anew")
    vocab = model.vocab.where(F.col("id") < vocab_size)
    made = model.merges.groupBy(F.col("merged").alias("token")).agg(F.min("rank").alias("rank"))
    last = made.join(vocab, "token").agg(F.max("rank")).first()[0]
    out = Subwords(model.family, vocab, model.merges.where(F.col("rank") <= (-1 if last is None else last)), model.words)
    tokens = token_splitter(out)(F.array("piece"))
    return Subwords(out.family, out.vocab, out.merges, model.words.select("piece", "frequency", tokens.alias("tokens")))


# --- encoding --------------------------------------------------------------------------------
def _splitter(family: str, ranks: dict, known: set):
    """Function from a piece to its tokens.  Small and self-contained, so that
    it can be sent to the Python workers on its own.  Its attribute ``many``, if
    there is one, splits a list of pieces to the same tokens, side by side."""
    unk, cont = UNKNOWN[0], CONTINUATION
    longest = max(map(len, known), default=0)  # of the vocabulary, so a long piece costs no more per character

    def longest_first(piece):
        out, start = [], 0
        while start < len(piece):
            head = "" if start == 0 else cont
            end = min(len(piece), start + longest)
            while end > start and head + piece[start:end] not in known:
                end -= 1
            if end == start:
                return [unk]
            out.append(head + piece[start:end])
            start = end
        return out

    def by_merges(piece):
        """The best pair first, its places from the left: a heap over a linked list."""
        import heapq

        parts = [f"{b:02X}" for b in piece.encode("utf-8")] if family == "bytes" else list(piece)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, (left, right) = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (parts[a], parts[b]) in ranks:
                    heapq.heappush(heap, (ranks[parts[a], parts[b]], a, (parts[a], parts[b])))
        return [p if p in known else unk for p in parts if p is not None]

    if family == "unigram":
        unknown, lattice = unigram.penalty(ranks), unigram.Lattice(ranks)

        def best_cut(piece):
            return [unk if t is None else t for t in unigram.best_cut(piece, ranks, unknown)[1]]

        best_cut.many = lambda pieces: [[unk if t is None else t for t in cut] for cut in lattice.cut(pieces)]
        return best_cut
    if family == "wordpiece":
        return longest_first
    side_by_side = SideBySide(ranks, known, unk, family == "bytes")
    by_merges.many = lambda pieces: side_by_side.cut(pieces, by_merges)
    return by_merges


def _tables(model: Subwords) -> tuple[dict, dict]:
    """Merge ranks (scores in the unigram family) and token ids; both at most the vocabulary size."""
    ranks: dict = {}
    if model.family == "unigram":
        rows = model.vocab.collect()
        return {r["token"]: r["score"] for r in rows if r["score"] is not None}, {r["token"]: r["id"] for r in rows}
    for r in model.merges.orderBy("rank").collect():
        ranks.setdefault((r["left"], r["right"]), r["rank"])
    ids = {r["token"]: r["id"] for r in model.vocab.collect()}
    return ranks, ids


def _split_batch(rows: pa.Array, split, memo: dict, kind: pa.DataType) -> pa.Array:
    """Lists of pieces to lists of what ``split`` gives for them; each different piece is split once.
    Pieces of earlier batches are kept in ``memo``, at most MEMO."""
    coded = rows.flatten().dictionary_encode()  # NULL rows have no pieces
    pieces = coded.dictionary.to_pylist()
    parts = [memo.get(p) for p in pieces]
    fresh = [k for k, found in enumerate(parts) if found is None]
    many = getattr(split, "many", lambda some: [split(p) for p in some])
    for lo in range(0, len(fresh), AT_ONCE):
        some = fresh[lo: lo + AT_ONCE]
        for k, found in zip(some, many([pieces[k] for k in some])):
            if len(memo) >= MEMO:
                memo.clear()
            parts[k] = memo[pieces[k]] = found
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.array([len(x) for x in parts], np.int64)
    begins, counts = (np.cumsum(sizes) - sizes)[which], sizes[which]
    ends = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(begins - ends[:-1], counts) + np.arange(ends[-1])
    lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
    offsets = ends[np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)]
    values = pa.array([t for x in parts for t in x], kind).take(pa.array(at, pa.int64()))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def token_splitter(model: Subwords):
    """Column function: array of pieces to array of tokens."""
    ranks, ids = _tables(model)
    split, memo = _splitter(model.family, ranks, set(ids)), {}

    @F.arrow_udf("array<string>")
    def encode(rows: pa.Array) -> pa.Array:
        return _split_batch(rows, split, memo, pa.string())

    return encode


def id_splitter(model: Subwords):
    """Column function: array of pieces to array of token ids."""
    ranks, ids = _tables(model)
    split, memo = _splitter(model.family, ranks, set(ids)), {}

    def to_ids(piece):
        return [ids[t] for t in split(piece)]

    if hasattr(split, "many"):
        to_ids.many = lambda pieces: [[ids[t] for t in tokens] for tokens in split.many(pieces)]

    @F.arrow_udf("array<int>")
    def encode(rows: pa.Array) -> pa.Array:
        return _split_batch(rows, to_ids, memo, pa.int32())

    return encode


def encode_words(words: DataFrame, model: Subwords, word: str = "word") -> DataFrame:
    """word, tokens for every distinct word, each encoded alone; dealt out evenly, as splitting costs far more than a word's size."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = words.select(word).distinct().repartition(parts, word)
    return distinct.select(word, token_splitter(model)(text_pieces(word, model.family)).alias("tokens"))


def encode_text(
    df: DataFrame, model: Subwords, text: str = "text", max_len: int = 128, bos: int = 0, eos: int = 1, pad: int = 3,
) -> DataFrame:
    """Adds ``input_ids`` and ``attention_mask`` of exactly ``max_len``.

    Row-local; specials enclose the ids, which are cut to leave room for them.
    A piece has at least one id, so no later pieces than there is room for are split.
    """
    pieces = F.slice(text_pieces(text, model.family), 1, max(0, max_len - 2))
    ids = df.withColumn("_ids", id_splitter(model)(pieces))
    framed = F.concat(F.array(F.lit(bos)), F.slice("_ids", 1, max_len - 2), F.array(F.lit(eos)))
    ids = ids.withColumn("_ids", framed)
    return (
        ids.withColumn("attention_mask", attention_mask("_ids", max_len))
        .withColumn("input_ids", fit_array("_ids", max_len, pad)).drop("_ids")
    )


def encode_pair(
    df: DataFrame, model: Subwords, first: str, second: str | None = None, max_len: int = 128,
    bos: int = 0, eos: int = 1, pad: int | None = 3,
) -> DataFrame:
    """One or two segments.  Over-long pairs lose tokens from the longer one
    first.  ``pad=None`` leaves padding to the batch."""
    to_ids = id_splitter(model)
    out = df.withColumn("_a", to_ids(text_pieces(first, model.family)))
    mark_b, mark_e = F.array(F.lit(bos)), F.array(F.lit(eos))
    if second is None:
        out = out.withColumn("input_ids", F.concat(mark_b, F.slice("_a", 1, max_len - 2), mark_e))
    else:
        room = max_len - 3
        out = out.withColumn("_b", to_ids(text_pieces(second, model.family)))
        la, lb = F.size("_a"), F.size("_b")
        short = F.least(F.least(la, lb), F.lit(room // 2))
        long = F.least(F.greatest(la, lb), F.lit(room) - short)
        keep_a, keep_b = F.when(la <= lb, short).otherwise(long), F.when(la <= lb, long).otherwise(short)
        out = out.withColumn(
            "input_ids",
            F.concat(mark_b, F.slice("_a", F.lit(1), keep_a), mark_e, F.slice("_b", F.lit(1), keep_b), mark_e),
        ).drop("_b")
    out = out.drop("_a")
    if pad is None:
        return out.withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))
    out = out.withColumn("attention_mask", attention_mask("input_ids", max_len))
    return out.withColumn("input_ids", fit_array("input_ids", max_len, pad))


# --- masking -----------------------------------------------------------------------------------
def _below(key: Column, share: float) -> Column:
    return key <= int(share * 2**KEY_BITS)


def _real_ids(ids: str, pad_id: int) -> Column:
    """The ids before the first pad."""
    first_pad = F.array_position(ids, F.lit(pad_id))
    return F.slice(ids, F.lit(1), F.when(first_pad == 0, F.size(ids)).otherwise(first_pad - 1).cast("int"))


# In the masking expressions an intermediate array is always an argument of a
# higher-order function, never a column used inside its lambda: Spark may put a
# column's expression in place of the column, and a lambda would then compute
# the whole array once per element.


def mask_tokens(
    df: DataFrame, keys: Sequence[str], ids: str = "input_ids", p: float = 0.15, mask_id: int = 2, pad_id: int = 3,
    seed: int | str = 0, epoch: int = 0, pad_label: int = IGNORED_LABEL,
) -> DataFrame:
    """Replace a share p of positions by the mask id; adds ``labels``.

    The choice is a hash of (seed, epoch, keys, position), so a retried task
    masks alike.  Positions from the first pad on are never masked; their label
    is ``pad_label`` (give ``pad_id`` to have them enter the loss).
    """
    hits = F.transform(_real_ids(ids, pad_id), lambda x, i: _below(hash_key(f"{seed}:{epoch}", *keys, i), p))
    staged = df.withColumn("_hit", hits)  # shorter than ids: zipping gives NULL from the first pad on
    labels = F.zip_with(
        ids, "_hit",
        lambda x, h: F.when(h, x).when(h.isNotNull(), F.lit(IGNORED_LABEL)).otherwise(F.lit(pad_label)),
    )
    inputs = F.zip_with(ids, "_hit", lambda x, h: F.when(h, F.lit(mask_id)).otherwise(x))
    return staged.withColumn("labels", labels).withColumn(ids, inputs).drop("_hit")


def mask_tokens_bert(
    df: DataFrame, keys: Sequence[str], vocab_size: int, ids: str = "input_ids", p: float = 0.15, mask_id: int = 2,
    pad_id: int = 3, seed: int | str = 0, epoch: int = 0,
) -> DataFrame:
    """The 80/10/10 variant: of the chosen positions, mask, random id, or keep."""
    other = lambda i: F.pmod(hash_key(f"{seed}:{epoch}:id", *keys, i), F.lit(vocab_size)).cast("int")
    drawn = F.transform(_real_ids(ids, pad_id), lambda x, i: hash_key(f"{seed}:{epoch}", *keys, i))
    # the replacement of a chosen position; NULL = keep the id
    swaps = F.transform(
        drawn,
        lambda u, i: F.struct(
            _below(u, p).alias("hit"),
            F.when(_below(u, 0.8 * p), F.lit(mask_id)).when(_below(u, 0.9 * p), other(i)).alias("id"),
        ),
    )
    staged = df.withColumn("_swap", swaps)
    inputs = F.zip_with(ids, "_swap", lambda x, s: F.coalesce(s["id"], x))
    labels = F.zip_with(ids, "_swap", lambda x, s: F.when(s["hit"], x).otherwise(F.lit(IGNORED_LABEL)))
    return staged.withColumn("labels", labels).withColumn(ids, inputs).drop("_swap")


def mask_check(df: DataFrame, ids: str = "input_ids", labels: str = "labels", mask_id: int = 2) -> DataFrame:
    """Adds masked and predicted position counts and whether they differ."""
    masked = F.size(F.filter(ids, lambda x: x == mask_id)).cast("bigint")
    predicted = F.size(F.filter(labels, lambda x: x != IGNORED_LABEL)).cast("bigint")
    return df.withColumn("n_masked", masked).withColumn("n_predicted", predicted).withColumn(
        "differs", F.col("n_masked") != F.col("n_predicted")
    )


# --- scores ------------------------------------------------------------------------------------
def word_shares(sentences: DataFrame, text: str = "text") -> DataFrame:
    """word, _n, _share: occurrences of each word, and the sum of its shares of the sentences."""
    # the share is fixed before the explode, not recomputed for every word
    split = sentences.select(F.split(text, " ").alias("_words")).withColumn("_share", F.lit(1.0) / F.size("_words"))
    rows = split.select(F.explode("_words").alias("word"), "_share")
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("_n"), F.sum("_share").alias("_share"))


def tokenizer_split_ratio(sentences: DataFrame, encoded: DataFrame, text: str = "text", shares: DataFrame | None = None) -> DataFrame:
    """Mean tokens per sentence, mean of tokens per word by sentence, mean
    tokens per word.

    Each is a sum over word occurrences of a weight times the word's token
    count, so occurrences are combined by word before the lookup; ``shares``
    has them (``word_shares``) where several vocabularies are compared.
    """
    per_word = word_shares(sentences, text) if shares is None else shares
    sized = per_word.join(encoded.select("word", F.size("tokens").alias("_t")), "word", "left")
    t = F.coalesce("_t", F.lit(0))
    n = sentences.agg(F.count(text)).scalar()
    return sized.agg(
        (F.sum(F.col("_n") * t) / n).alias("sentence_length"),
        (F.sum(F.col("_share") * t) / n).alias("sentence_split_ratio"),
        (F.sum(F.col("_n") * t) / F.sum("_n")).alias("word_split_ratio"),
    )


def unk_rate(examples: DataFrame, tokens: Column | str, by: str = "task") -> DataFrame:
    """Per task: share of examples with at least one unknown token."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    hit = F.exists(tokens, lambda t: t.isin(*UNKNOWN))
    return examples.groupBy(by).agg(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("unk_rate"))


def morph_parts(encoded: DataFrame, parts: DataFrame, strip_marks: bool = True) -> DataFrame:
    """word, token, hit: tokens that are reference parts of their word.

    Words left whole or cut to single characters are out.  ``strip_marks``
    also removes the word-boundary marks of the other families.
    """
    marks = "[#_▁Ġ]" if strip_marks else "[#_]"
    size = F.size("tokens")
    # decided inside the generator: a filter would be pushed down and encode again
    cut = F.when((size != 1) & (size != F.length("word")), F.col("tokens"))
    tokens = encoded.join(parts, "word").select("word", "parts", F.explode(cut).alias("_t"))
    bare = F.regexp_replace("_t", marks, "")
    return tokens.select("word", bare.alias("token"), F.array_contains("parts", bare).alias("hit"))


def morph_score(encoded: DataFrame, parts: DataFrame, strip_marks: bool = True) -> DataFrame:
    """Matched parts over all parts."""
    total = parts.agg(F.sum(F.size("parts"))).scalar()
    hits = morph_parts(encoded, parts, strip_marks)
    return hits.agg((F.count_if("hit") / total).alias("morph_score"))
