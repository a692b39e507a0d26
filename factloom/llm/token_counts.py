"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary's two tries (word-initial pieces and continuation pieces) get
failure links: the link of a state leads to the continuation-trie state that
spells what remains after the greedy pieces have been popped, and the number
of popped pieces is computed once per link.  A word of n characters is counted
in O(n) steps and no piece is ever built.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

from .common import MEMO_WORD_CHARS, MEMO_WORDS, map_texts


class LongestMatch:
    """Counts the greedy longest-match pieces of a word; ``None`` where no segmentation exists."""

    def __init__(self, initial: list[str], continuing: list[str]):
        self.next: list[dict[str, int]] = [{}, {}]  # 0: word start, 1: inside a word
        final = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                at = root
                for ch in piece:
                    to = self.next[at].get(ch)
                    if to is None:
                        to = self.next[at][ch] = len(self.next)
                        self.next.append({})
                        final.append(False)
                    at = to
                final[at] |= at != root
        n = len(self.next)
        self.fail = [-1] * n
        self.popped = [0] * n
        order = [0, 1]
        for at in order:  # breadth first: a link leads to a shallower state
            for ch, to in self.next[at].items():
                order.append(to)
                if final[to]:
                    self.fail[to], self.popped[to] = 1, 1
                    continue
                count, link = self.popped[at], self.fail[at]
                while link >= 0 and ch not in self.next[link]:
                    count, link = count + self.popped[link], self.fail[link]
                if link >= 0:
                    self.fail[to], self.popped[to] = self.next[link][ch], count

    def count(self, word: str) -> int | None:
        nexts, fail, popped = self.next, self.fail, self.popped
        at = pieces = 0
        for ch in word:
            while (to := nexts[at].get(ch)) is None:
                pieces += popped[at]
                at = fail[at]
                if at < 0:
                    return None
            at = to
        while at != 1:
            if at <= 0 or fail[at] < 0:
                return None if word else 0
            pieces += popped[at]
            at = fail[at]
        return pieces


def brute_count(word: str, initial: set[str], continuing: set[str]) -> int | None:
    """Greedy longest match by trying every length; the definition that the automaton is tested against."""
    at = pieces = 0
    while at < len(word):
        among = continuing if at else initial
        for end in range(len(word), at, -1):
            if word[at:end] in among:
                at, pieces = end, pieces + 1
                break
        else:
            return None
    return pieces


#: Stands before every word; a vocabulary may hold it as a piece of its own.
MARK = "\u2581"


def read_pieces(path: str) -> tuple[list[str], list[str]]:
    """Word-initial and continuation pieces of a sentencepiece model: those that begin with its word mark, kept, and those that don't."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    initial, continuing = [], []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        (initial if piece.startswith(MARK) else continuing).append(piece)
    return initial, continuing


@lru_cache(maxsize=2)
def automaton(path: str) -> tuple[LongestMatch, dict[str, int]]:
    return LongestMatch(*read_pieces(path)), {}


def token_counts(documents: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_tokens, n_unknown``.

    Words are the maximal runs free of ASCII white space, each behind the word
    mark; the mark alone is a token where the vocabulary has it and no longer
    piece begins the word.  A word that the vocabulary cannot spell counts as
    one token and as unknown.  A null or
    empty text has no words (three zeros); repeated rows give repeated rows; an
    empty table gives an empty table; other columns are not read.
    """

    def each(keys, texts):
        matcher, memo = automaton(vocabulary)
        words_of, tokens_of, unknown_of = [], [], []
        for t in texts:
            words = t.encode("utf-8", "surrogatepass").split()
            tokens = unknown = 0
            for w in words:
                n = memo.get(w)
                if n is None:
                    found = matcher.count(MARK + w.decode("utf-8", "surrogatepass"))
                    n = -1 if found is None else found
                    if len(w) <= MEMO_WORD_CHARS:
                        if len(memo) >= MEMO_WORDS:
                            memo.clear()
                        memo[w] = n
                if n < 0:
                    unknown += 1
                    tokens += 1
                else:
                    tokens += n
            words_of.append(len(words))
            tokens_of.append(tokens)
            unknown_of.append(unknown)
        return keys, words_of, tokens_of, unknown_of

    kind = documents.select(key).schema[0].dataType.simpleString()
    return map_texts(documents, each, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long", key=key, text=text)
