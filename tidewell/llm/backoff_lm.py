"""Language-model scoring by a weighted backoff automaton over smoothed n-grams.

States are the contexts of up to ORDER - 1 tokens that training has seen continued, from the start of a text down to the root (no
context).  A state has an arc for each continuation seen in training, weighted by its smoothed
probability, and one failure arc to the state of the context without its first token, weighted by the mass
left to unseen continuations; the root has an arc for every token.  A text is read once from left to
right: each token takes the state's arc, or fails until a state has one, adds the weights in log10, and moves
on to the state where the arc leads, that of the longest context seen.

    P(w)     = (c(w) + 1) / (N + V + 1)                      root, add-one, one share for the unknown
    P(w | h) = (c(h w) + k P(w | h')) / (c(h) + k)           h' is h without its first token; k by the length of h
    failure  = k / (c(h) + k)                                1 for a context never seen, which is no state

which is interpolation with a Dirichlet prior. Its strength k for contexts of one length is estimated from the
training counts alone, as the evidence's maximum in MacKay and Peto's approximation (1995): k K(k) = T, where T is the number of
distinct n-grams one token longer, and K(k) = sum over contexts of log(1 + c(h) / k). Both are sums over the buckets.

Counting: a block of documents sends its distinct n-grams of every order with their training counts to
buckets of key ranges; the buckets add the counts up and answer with the totals, in the order the
keys were sent, so only counts come back.  N, V, T and K come back as each bucket's share.  Every block
then builds the states and arcs that its own texts can take, and walks its texts: its tokens are cut into
LANES stretches that advance together, one token a step, each begun ORDER - 1 tokens early, after which the state no
longer depends on where it began.  No vocabulary is collected anywhere.
Tokens are 64-bit hashes; longer n-grams keep BITS of them whatever the size of the corpus, so that of S seen ones one unseen in
2**BITS / S looks seen.

Tokens: words with A-Z lowered, then one end.  Edge cases: a null or empty text is one end token; a
row without an id is not trained on, and its id comes back null; rows that share an id are trained on or held out
alike, each counting; a text of any length is scored whole; without training rows every token has P = 1 / (0 + 0 + 1); an
empty table gives an empty result; columns other than the two named are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import exchange
from .textscan import WORD_BASE, Words, chunks, mix, texts

END = np.uint64(0x51A7E0F0E4D00001)
START = np.uint64(0x51A7E0F05A2700A3)
ORDER = 3
#: Bits of the hash of an n-gram of two tokens or more.
BITS = 52
#: Strengths between which the evidence's maximum is interpolated.
STRENGTHS = 2.0 ** np.arange(-2, 21)
#: Sums of logarithms are added up as whole numbers of this part.
UNIT = 2.0**-16
#: Stretches of a block's tokens that advance together.
LANES = 4096
#: Larger than usual: the more text a block holds, the fewer n-grams does it send that others send too.
BLOCK_BYTES = 6 << 20


def held_out(ids: np.ndarray, modulus: int, remainder: int) -> np.ndarray:
    """Whether crc32 of the id as text leaves ``remainder``."""
    return np.array([zlib.crc32(b"%d" % i) % modulus == remainder for i in ids.tolist()], dtype=bool)


def extended(grams: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Hashes of n-grams one token longer."""
    return mix(grams * np.uint64(WORD_BASE) + token)


class Block:
    """A block's n-grams of every order: sorted distinct keys, their training counts, and each position's place among them.

    ``gram[k]`` and ``context[k]`` are, for each position, the places of the (k + 1)-gram that ends there and of the one that
    ends before it; texts begin after as many starts as needed, whose places are ``start``; ``first`` tells where a text begins.
    """

    def __init__(self, table: pa.Table, modulus: int, remainder: int, order: int, bits: int = BITS):
        nameless = pc.is_null(table.column("id")).to_numpy().astype(bool)
        self.held = held_out(exchange.order(table), modulus, remainder) & ~nameless
        trained = ~self.held & ~nameless
        text = texts(table.column("text"))
        tokens, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, j, offsets, data in chunks(text):
            words = Words(offsets, data)
            ends = words.bounds[1:]  # after a row's last word comes its end
            tokens.append(np.insert(words.hashes(data, lower=True), ends, END))
            rows.append(np.insert(words.row, ends, np.arange(j - i)) + i)
        token, self.row = np.concatenate(tokens), np.concatenate(rows)
        first = np.append(True, self.row[1:] != self.row[:-1])[: len(token)]
        weight = trained[self.row].astype(float)
        self.keys, self.counts, self.gram, self.context, self.start, self.first = [], [], [], [], [], first
        start, whole = START, token
        for k in range(order):
            if k:
                before = np.empty_like(whole)
                before[1:] = whole[:-1]
                before[first] = start
                whole = extended(before, token)
                start = extended(np.array([start]), np.array([START]))[0]
            mask = ~np.uint64(0) << np.uint64(64 - bits if k else 0)
            keys, place = np.unique(np.append(whole, start) & mask, return_inverse=True)
            counts = np.bincount(place, weights=np.append(weight, trained.sum()), minlength=len(keys)).astype(np.int64)
            context = np.empty(len(token), dtype=np.int64)
            context[1:] = place[:-2]
            context[first] = place[-1]
            self.keys.append(keys)
            self.counts.append(counts)
            self.gram.append(place[:-1])
            self.context.append(context)
            self.start.append(int(place[-1]))

    def sections(self) -> list[exchange.Section]:
        """By order: keys, training counts, and whether the n-gram is a text's end, after which nothing comes."""
        return [(keys, [counts, self.over(k)]) for k, (keys, counts) in enumerate(zip(self.keys, self.counts))]

    def over(self, k: int) -> np.ndarray:
        """By (k + 1)-gram: whether it ends a text."""
        out = np.zeros(len(self.keys[k]), dtype=bool)
        out[self.gram[k][np.append(self.first[1:], True)[: len(self.first)]]] = True
        return out


def add_up(asked: list[tuple[np.ndarray, np.ndarray, list]]) -> tuple[list[list[np.ndarray]], list[int]]:
    """Totals of every n-gram sent, and this bucket's share of N, of V, of distinct seen n-grams by order, and of K by length of context."""
    answers, share, kinds, sums = [], [0, 0], [], []
    for k, (keys, _, columns) in enumerate(asked):
        seen = total = np.zeros(0, np.int64)
        if len(keys):
            distinct, first, place = np.unique(keys, return_index=True, return_inverse=True)
            total = np.bincount(place, weights=columns[0]).astype(np.int64)
            if not k:
                real = distinct != START
                share = [int(total[real].sum()), int((total[real] > 0).sum())]
            kinds.append(int((total > 0).sum()))
            seen = total[(total > 0) & (columns[1][first] == 0)]  # contexts: nothing follows an end
        else:
            kinds.append(0)
        answers.append([total[place]] if len(keys) else [])
        if k + 1 < len(asked):
            often, times = np.unique(seen, return_counts=True)
            sums += np.round((np.log1p(often[None] / STRENGTHS[:, None]) * times).sum(axis=1) / UNIT).astype(np.int64).tolist()
    return answers, [*share, *kinds, *sums]


def strengths(note: np.ndarray, order: int) -> list[float]:
    """The prior's strength for contexts of one token, two tokens and so on, from the sum of the buckets' shares."""
    kinds, sums = note[2 : 2 + order], note[2 + order :].reshape(order - 1, len(STRENGTHS)) * UNIT
    out = []
    for k in range(order - 1):
        rises = np.log(np.maximum(STRENGTHS * sums[k], 1e-300))  # of k K(k), which grows with k
        wanted = np.log(max(1, int(kinds[k + 1]) - 1))  # nothing ends with the start
        out.append(float(np.exp(np.interp(wanted, rises, np.log(STRENGTHS)))))
    return out


def smoothed(counts: list[np.ndarray], prior: list[float], n: int, v: int, gram: list[np.ndarray], context: list[np.ndarray]) -> np.ndarray:
    """P of the token at each position after its context there, by the formula: what the automaton's weights multiply to."""
    p = (counts[0][gram[0]] + 1.0) / (n + v + 1.0)
    for k in range(len(counts) - 1):
        c = counts[k][context[k]]
        p = (counts[k + 1][gram[k + 1]] + prior[k] * p) / (c + prior[k])
    return p


class Automaton:
    """States and arcs that a block's texts can take.

    State 0 is the root; contexts that training has seen follow, by length. ``fails`` and ``failure`` are each state's failure arc: where it leads and
    its log10 weight. ``arcs`` are the sorted keys state * symbols + token, ``leads`` and ``weight`` where each leads and its log10 weight.
    """

    def __init__(self, own: Block, counts: list[np.ndarray], prior: list[float], n: int, v: int):
        order = len(counts)
        self.symbols = len(counts[0])
        # Numbers of the states: of every (k + 1)-gram that is a context some longer one was seen after, or could be.
        number, first = [], 1
        for k in range(order - 1):
            seen = (counts[k] > 0) & ~own.over(k)
            number.append(np.where(seen, first + np.cumsum(seen) - 1, -1))
            first += int(seen.sum())
        # For every distinct n-gram one position where it ends; the starts' n-grams end nowhere.
        where = [np.full(len(c), -1) for c in counts]
        for k in range(order):
            where[k][own.gram[k][::-1]] = np.arange(len(own.gram[k]))[::-1]
        suffix = self._suffixes(own, counts, number)
        self.fails, self.failure = np.zeros(first, np.int64), np.zeros(first)
        for k in range(order - 1):
            at = np.flatnonzero(number[k] >= 0)
            self.failure[number[k][at]] = np.log10(prior[k] / (counts[k][at] + prior[k]))
            if k:
                self.fails[number[k][at]] = suffix[k - 1][at]
        keys, leads, weight = [], [], []
        for k in range(order):
            at = np.flatnonzero((where[k] >= 0) & ((counts[k] > 0) | (k == 0)))
            spot = where[k][at]
            state = number[k - 1][own.context[k - 1][spot]] if k else np.zeros(len(at), np.int64)
            token = own.gram[0][spot]
            p = smoothed(counts[: k + 1], prior, n, v, [g[spot] for g in own.gram[: k + 1]], [c[spot] for c in own.context[:k]])
            keys.append(state * self.symbols + token)
            weight.append(np.log10(p))
            if k < order - 1:
                target = number[k][at]
                leads.append(np.where(target >= 0, target, 0))
            else:
                leads.append(suffix[k - 1][at] if k else np.zeros(len(at), np.int64))
        key, lead, cost = np.concatenate(keys), np.concatenate(leads), np.concatenate(weight)
        way = np.argsort(key, kind="stable")
        self.arcs, self.leads, self.weight = key[way], lead[way], cost[way]
        self.starts = max([0, *[int(number[k][own.start[k]]) for k in range(order - 1)]])
        self.memory = order - 1

    @staticmethod
    def _suffixes(own: Block, counts: list[np.ndarray], number: list[np.ndarray]) -> list[np.ndarray]:
        """For every (k + 2)-gram the state of the longest context that it ends with, itself left out."""
        out = []
        for k in range(len(counts) - 1):
            best = np.zeros(len(counts[k + 1]), np.int64)
            for j in range(k + 1):
                found = number[j][own.gram[j]]
                known = found >= 0
                best[own.gram[k + 1][known]] = found[known]  # longer ones later, which win
            # After a start comes what the start's shorter context is.
            for j in range(k + 1):
                if number[j][own.start[j]] >= 0:
                    best[own.start[k + 1]] = number[j][own.start[j]]
            out.append(best)
        return out

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, log10 weights): failure arcs to the first state with an arc for the token, and that arc."""
        state, cost, left = state.copy(), np.zeros(len(state)), np.arange(len(state))
        while len(left):
            key = state[left] * self.symbols + token[left]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            hit = self.arcs[at] == key
            took = left[hit]
            state[took] = self.leads[at[hit]]
            cost[took] += self.weight[at[hit]]
            left = left[~hit]
            cost[left] += self.failure[state[left]]
            state[left] = self.fails[state[left]]
        return state, cost

    def walk(self, token: np.ndarray, first: np.ndarray, lanes: int = LANES) -> np.ndarray:
        """log10 weight of each token of texts one after another; ``first`` tells where a text begins."""
        out = np.zeros(len(token))
        size = -(-len(token) // lanes)
        begin = np.arange(0, len(token), max(1, size))
        state = np.full(len(begin), self.starts)
        for step in range(-self.memory, size):
            at = begin + step
            live = np.flatnonzero((at >= 0) & (at < np.minimum(begin + size, len(token))))
            at = at[live]
            before = np.where(first[at], self.starts, state[live])
            state[live], cost = self.step(before, token[at])
            if step >= 0:
                out[at] = cost
        return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2, order: int = ORDER) -> DataFrame:
    """Returns (id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Rows whose crc32 of the id as text, modulo ``modulus``, is ``remainder`` are held out of training.
    """
    rows, blocks, total = exchange.blocked(docs, id_col, text_col, block_bytes=BLOCK_BYTES)
    tokens = total / 6 + 1
    dealt = exchange.evenly(exchange.deal(tokens * 5 * order, blocks, tokens * (order - 0.5) / blocks), rows)

    def block(table: pa.Table) -> Block:
        return Block(table, modulus, remainder, order)

    def read(table: pa.Table, got) -> pa.Table:
        own, size = block(table), table.num_rows
        counts = [a[0].astype(np.int64) for a in got(own.sections())]
        n, v = got.note[:2].tolist()
        machine = Automaton(own, counts, strengths(got.note, order), n, v)
        root = np.log10((counts[0] + 1.0) / (n + v + 1.0))
        by_row = lambda values: np.bincount(own.row, weights=values, minlength=size)
        return pa.table(
            {
                id_col: table.column("id"), "held_out": pa.array(own.held), "n_tokens": pa.array(np.bincount(own.row, minlength=size).astype(np.int64)),
                "n_known": pa.array(by_row(counts[0][own.gram[0]] > 0).astype(np.int64)), "train_tokens": pa.array(np.full(size, n, np.int64)),
                "base_score": pa.array(by_row(root[own.gram[0]])), "score": pa.array(by_row(machine.walk(own.gram[0], own.first))),
            }
        )

    answers = exchange.answer(exchange.send(rows, dealt, lambda table: block(table).sections(), True), dealt, add_up, True)
    schema = f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return exchange.finish(rows, answers, read, schema)
