"""Language-model scores by a weighted backoff automaton built from corpus counts."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenforge.llm.blocks import Shelf, mixed, narrow, pack, parts, steps, unpack
from lumenforge.llm.common import RollingCache, held_out_column, ship_package

#: Words in the longest n-gram, and occurrences that make a context a state.
ORDER, MIN_CONTEXT = 3, 2
#: Prior weight of the lower order in contexts of one, two, ... tokens; the last holds for all longer ones.
PRIORS = (1000.0, 30.0)
#: Tokens of a block, and of the corpus for each shard; what a task holds follows from them, whatever the corpus' size.
BLOCK_TOKENS, SHARD_TOKENS = 1 << 19, 1 << 22

_END = np.uint64(xxhash.xxh64_intdigest(b"\x00end"))


def _tokenised(block_tokens: int):
    """Blocks of documents: ids, lengths and training marks of documents, words' hashes by frequency, tokens as places among them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = RollingCache(xxhash.xxh64_intdigest, 200_000)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        rows, streams, size, seq = [], [], 0, 0

        def flush():
            words, places, times = np.unique(np.concatenate(streams), return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")  # frequent words get small places
            at = np.empty(len(order), np.uint32)
            at[order] = np.arange(len(order), dtype=np.uint32)
            lengths = np.array([len(s) for s in streams], np.int64)
            train = np.array([r[1] for r in rows], np.uint8)
            body = pack(lengths, train, words[order], at[places.ravel()])
            return pd.DataFrame({"block": [(part << 32) + seq], "n_tokens": [size], "n_train": [int(train.sum())], "ids": [[r[0] for r in rows]], "body": [body]})

        for b in batches:
            for i, x, held in zip(b["id"], b["x"], b["held"], strict=True):
                words = (x or "").encode("utf-8", "surrogatepass").lower().split()
                rows.append((i, not held))
                streams.append(np.append(np.fromiter(map(table.__getitem__, words), np.uint64, len(words)), _END))
                size += len(streams[-1])
                if size >= block_tokens:
                    yield flush()
                    rows, streams, size, seq = [], [], 0, seq + 1
        if rows:
            yield flush()

    return run


class _Grams:
    """The distinct n-grams of one order in a block: owner and key of each (ascending within an owner), and at every token its n-gram (or -1)."""

    def __init__(self, shard: np.ndarray, key: np.ndarray, at: np.ndarray, counted: np.ndarray):
        self.shard, self.key, self.at = shard, key, at
        there = at >= 0
        self.mine = np.bincount(at[there & counted], minlength=len(key)).astype(np.uint32)
        self.first = np.zeros(len(key), np.int64)
        places = np.flatnonzero(there)[::-1]
        self.first[at[places]] = places
        self.count = np.zeros(len(key), np.int64)
        self.number = np.full(len(key), -1, np.int64)

    def asks(self) -> Iterator[tuple[int, bytes]]:
        for s, p in parts(self.shard):
            yield s, pack(narrow(steps(self.key[p])), narrow(self.mine[p]))

    def take(self, shards: int, answers: dict[int, bytes]) -> None:
        """Fill in corpus counts, and numbers of the n-grams that were given one."""
        for s, p in parts(self.shard):
            count, named, rank = unpack(answers[s])
            self.count[p] = count
            self.number[p[np.unpackbits(named, count=len(p)).astype(bool)]] = np.cumsum(rank, dtype=np.int64) * shards + s


class _Block:
    """A block's n-grams, order by order, as far as the shards have answered. ``bits``: of the largest rank that a word has in a shard."""

    def __init__(self, body: bytes, shards: int, starts: int = 0, min_context: int = 1, bits: int = 0):
        self.shards, self.starts, self.min_context, self.bits = shards, starts, min_context, bits
        self.lengths, train, words, places = unpack(body)
        self.train = train.astype(bool)
        self.begins = np.concatenate(([0], np.cumsum(self.lengths)[:-1])).astype(np.int64)
        self.counted = np.repeat(self.train, self.lengths)
        self.opens = np.zeros(len(places), bool)
        self.opens[self.begins] = True
        order = np.argsort(words)
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        words = words[order]
        self.orders = [_Grams((mixed(words) % np.uint64(shards)).astype(np.int64), words, place[places], self.counted)]

    def grow(self) -> None:
        """Add the next order: n-grams whose context is a state and whose last word, or suffix, occurs in training."""
        top = self.orders[-1]
        context = np.full(len(top.at), -1, np.int64)  # the start is 0, others their number plus 1
        if len(top.key):
            state = np.where(top.count >= self.min_context, top.number + 1, -1)
            context[1:] = np.where(top.at[:-1] >= 0, state[top.at[:-1]], -1)
        context[self.opens] = 0 if len(self.orders) == 1 and self.starts >= self.min_context else -1
        word = self.orders[0].number[self.orders[0].at]
        suffix = (top.at >= 0) & (top.count[top.at] > 0) if len(top.key) else np.zeros(len(top.at), bool)
        there = np.flatnonzero((context >= 0) & (word >= 0) & suffix)
        c, w, where = _distinct(context[there], word[there])
        at = np.full(len(top.at), -1, np.int64)
        at[there] = where
        # the owner follows from context and word, so that frequent contexts are spread; of the word, its rank is left to tell
        shard = ((mixed(c.astype(np.uint64)) % np.uint64(self.shards)).astype(np.int64) + w) % self.shards
        if len(c) and int(c.max()).bit_length() + self.bits > 64:
            raise OverflowError("contexts and words of a shard do not fit in 64 bits; raise min_context or lower shard_tokens")
        key = (c.astype(np.uint64) << np.uint64(self.bits)) | (w // self.shards).astype(np.uint64)
        self.orders.append(_Grams(shard, key, at, self.counted))

    def replay(self, answers: dict[int, dict[int, bytes]]) -> None:
        """Take the answers of each order in turn, growing the next from them."""
        for n in sorted(answers):
            if n > len(self.orders):
                self.grow()
            self.orders[n - 1].take(self.shards, answers[n])


def _distinct(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, and each row's place among them."""
    if not len(word):
        return context, word, context
    bits = int(word.max()).bit_length()
    if int(context.max()).bit_length() + bits <= 63:
        keys, where = np.unique(context << bits | word, return_inverse=True)
        return keys >> bits, keys & ((1 << bits) - 1), where.ravel()
    order = np.lexsort((word, context))
    c, w = context[order], word[order]
    new = np.concatenate(([True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])))
    where = np.empty(len(order), np.int64)
    where[order] = np.cumsum(new) - 1
    return c[new], w[new], where


def _answers_of(rows: pd.DataFrame) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for n, s, body in zip(rows["n"], rows["shard"], rows["body"], strict=True):
        out.setdefault(int(n), {})[int(s)] = body
    return out


def _asked(order: int, shards: int, starts: int, min_context: int, bits: int):
    """The keys of ``order`` that each block asks for, given the answers of the orders below."""

    def run(key: tuple, blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(blocks):
            x = _Block(blocks["body"].iloc[0], shards, starts, min_context, bits)
            x.replay(_answers_of(answers))
            if order > len(x.orders):
                x.grow()
            out = [(s, int(key[0]), body) for s, body in x.orders[-1].asks()]
        return pd.DataFrame(out, columns=["shard", "block", "body"])

    return run


def _first_asked(shards: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, body in zip(b["block"], b["body"], strict=True):
                x = _Block(body, shards)
                yield pd.DataFrame([(s, block, m) for s, m in x.orders[0].asks()], columns=["shard", "block", "body"])

    return run


def _answered(order: int, least: int):
    """Corpus counts of every block's keys of one shard, and numbers of those that occur ``least`` times (their ranks in the shard)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = [], []
        for body in rows["body"]:
            k, c = unpack(body)
            keys.append(np.cumsum(k, dtype=np.uint64))
            counts.append(c)
        names, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place.ravel(), weights=np.concatenate(counts), minlength=len(names)).astype(np.uint64)
        named = total >= least
        rank = np.cumsum(named) - 1
        out, at = [], 0
        for block, k in zip(rows["block"], keys, strict=True):
            p = place.ravel()[at : at + len(k)]
            at += len(k)
            out.append((int(block), order, int(key[0]), pack(narrow(total[p]), np.packbits(named[p]), narrow(steps(rank[p][named[p]].astype(np.uint64)))), 0, 0))
        out.append((-1, order, int(key[0]), b"", int(total.sum()), int((total > 0).sum())))
        return pd.DataFrame(out, columns=["block", "n", "shard", "body", "tokens", "distinct"])

    return run


def _prior(priors: Sequence[float], context: int) -> float:
    return float(priors[min(context, len(priors)) - 1])


class Automaton:
    """The part of the corpus' automaton that one block's texts can reach.

    State 0 is the empty context: it has an arc for every word. Other states are contexts, the start among them; a
    state's arcs carry smoothed log10 probabilities of the words seen after it, and its failure arc the weight of
    leaving it for its longest proper suffix that is a state.
    """

    def __init__(self, x: _Block, tokens: int, distinct: int, priors: Sequence[float], order: int):
        uni = x.orders[0]
        base = (uni.count + 1) / (tokens + 1.0 * (distinct + 1))
        self.root = np.log10(base)
        self.width = len(uni.key)
        n_states = [0, 1]  # of orders 0 and 1 on: where their states begin
        for g in x.orders:
            n_states.append(n_states[-1] + len(g.key))
        start = n_states[-1]
        seen = np.concatenate([[0], *(g.count for g in x.orders), [x.starts]]).astype(float)
        self.start = start if order > 1 and x.starts >= x.min_context else 0
        prior = np.concatenate([[1.0], *(np.full(len(g.key), _prior(priors, k)) for k, g in enumerate(x.orders, 1)), [_prior(priors, 1)]])
        self.leave = np.log10(prior / (seen + prior)).tolist()
        # at each token, the longest context that is a state once it is read, by order
        reached = [np.zeros(len(uni.at), np.int64)]
        for k, g in enumerate(x.orders[: order - 1]):
            state = np.where(g.count >= x.min_context, n_states[k + 1] + np.arange(len(g.key)), -1)
            mine = np.where(g.at >= 0, state[g.at] if len(state) else -1, -1)
            reached.append(np.where(mine >= 0, mine, reached[-1]))
        fail = [np.zeros(1, np.int64), np.zeros(len(uni.key), np.int64)]
        self.root_to = reached[min(1, order - 1)][uni.first].tolist()
        arcs, weights, targets = [], [], []
        below = base[uni.at]  # at each token, its probability in the order below
        for k, g in enumerate(x.orders[1:], start=2):
            source = np.where(x.opens[g.first], start, reached[k - 1][g.first - 1]) if k == 2 else reached[k - 1][g.first - 1]
            here = g.count > 0
            p = (g.count + prior[source] * below[g.first]) / (seen[source] + prior[source])
            arcs.append((source * self.width + uni.at[g.first])[here])
            weights.append(np.log10(p)[here])
            targets.append(reached[min(k, order - 1)][g.first][here])
            fail.append(reached[k - 1][g.first])
            below = np.where(g.at >= 0, p[g.at] if len(p) else 0.0, 0.0)
        fail.append(np.zeros(1, np.int64))
        self.fail = np.concatenate(fail).tolist()
        self.root = self.root.tolist()
        self.arcs: dict[int, int] = {}
        self.weight: list[float] = []
        self.target: list[int] = []
        if arcs:
            keys = np.concatenate(arcs)
            self.arcs = dict(zip(keys.tolist(), range(len(keys)), strict=True))
            self.weight, self.target = np.concatenate(weights).tolist(), np.concatenate(targets).tolist()

    def score(self, words: list[int]) -> float:
        """log10 probability of one text: a single traversal from left to right."""
        get, weight, target, width = self.arcs.get, self.weight, self.target, self.width
        leave, fail, root, root_to = self.leave, self.fail, self.root, self.root_to
        state, total = self.start, 0.0
        for w in words:
            while state:
                arc = get(state * width + w)
                if arc is not None:
                    total += weight[arc]
                    state = target[arc]
                    break
                total += leave[state]
                state = fail[state]
            else:
                total += root[w]
                state = root_to[w]
        return total


def _traversed(shards: int, starts: int, min_context: int, bits: int, tokens: int, distinct: int, priors: Sequence[float], order: int):
    def run(key: tuple, blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks):
            return pd.DataFrame({"id": [], "held_out": [], "n_tokens": [], "n_known": [], "base_score": [], "score": []})
        x = _Block(blocks["body"].iloc[0], shards, starts, min_context, bits)
        x.replay(_answers_of(answers))
        a = Automaton(x, tokens, distinct, priors, order)
        uni = x.orders[0]
        log_base = np.array(a.root)
        return pd.DataFrame(
            {
                "id": list(blocks["ids"].iloc[0]),
                "held_out": ~x.train,
                "n_tokens": x.lengths,
                "n_known": np.add.reduceat((uni.count > 0)[uni.at].astype(np.int64), x.begins),
                "base_score": np.add.reduceat(log_base[uni.at], x.begins),
                "score": [a.score(uni.at[i : i + n].tolist()) for i, n in zip(x.begins.tolist(), x.lengths.tolist(), strict=True)],
            }
        )

    return run


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    modulus: int = 7,
    remainder: int = 2,
    order: int = ORDER,
    priors: Sequence[float] = PRIORS,
    min_context: int = MIN_CONTEXT,
    block_tokens: int = BLOCK_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """log10 probability of every whole text under a smoothed n-gram automaton learnt from the training rows.

    Rows whose crc32 of the id as text leaves ``remainder`` are held out of training. A context h of up to ``order - 1``
    tokens (a text's start among them) that occurs at least ``min_context`` times is a state: P(w | h) = (c(h w) + prior *
    P(w | h')) / (c(h) + prior), h' its longest proper suffix and prior that of ``priors`` for h's length. Other contexts are left for h' without weight. The empty context has
    the add-one unigram distribution. Seen n-grams are arcs; all other words take failure arcs of weight prior / (c(h) + prior).

    Blocks of documents ask shards of the counts, an order at a time, for the n-grams they hold and get back counts and numbers,
    from which they build the part of the automaton that they traverse; a frequent n-gram is one entry for each
    block. Words are told apart by 64-bit hashes, n-grams exactly, by the numbers of their context and word.
    Null text counts as empty: the end token alone. Rows with repeated ids are each scored; a null id counts as training.
    Empty input gives no rows; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    x = F.col(text_col).cast("string")
    held = F.coalesce(held_out_column(F.col(id_col), modulus, remainder), F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), x.alias("x"), held.alias("held"))
    kind = rows.schema["id"].dataType.simpleString()
    blocks = Shelf(docs.sparkSession, "lm-blocks").add(rows.mapInPandas(_tokenised(block_tokens), f"block long, n_tokens long, n_train long, ids array<{kind}>, body binary"))
    size, starts = (int(v or 0) for v in blocks.agg(F.sum("n_tokens"), F.sum("n_train")).first())
    shards = max(6, math.ceil(size / shard_tokens))

    message, answer = "shard long, block long, body binary", "block long, n int, shard long, body binary, tokens long, distinct long"
    body = blocks.select("block", "body").groupBy("block")
    shelf, answers = Shelf(docs.sparkSession, "lm-answers"), None
    for n in range(1, order + 1):
        asks = blocks.select("block", "body").mapInPandas(_first_asked(shards), message) if n == 1 else body.cogroup(answers.groupBy("block")).applyInPandas(_asked(n, shards, starts, min_context, bits), message)
        told = shelf.add(asks.groupBy("shard").applyInPandas(_answered(n, 1 if n == 1 else min_context), answer), moved=True)
        if n == 1:
            tokens, distinct, most = (int(v or 0) for v in told.where("block = -1").agg(F.sum("tokens"), F.sum("distinct"), F.max("distinct")).first())
            bits = most.bit_length()
        answers = told.where("block >= 0").select("block", "n", "shard", "body")
    fields = f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = blocks.select("block", "ids", "body").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_traversed(shards, starts, min_context, bits, tokens, distinct, tuple(priors), order), fields)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
