"""A BPE vocabulary with word ends as a deterministic transducer over the bytes of words.

Let t(i) be the last token of the tokenization of a word's first i bytes. It is the one vocabulary entry
that ends there and whose pair with the token before it is *stable*: tokenizing the two texts
joined gives the two tokens again. So t and the number of tokens n follow from left to right. Only
start positions from which a longer token may still grow can matter later, which makes the set of
states finite: a state is the list of those open starts, each with its bytes so far, its t and its n,
relative to the n of the current position. A transition emits the change of n; leaving the word emits
the difference to the tokenization in which the last byte carries the word end.

States are compiled when first reached, up to a bound at which the compiler starts anew.

A chunk of bytes maps each entry state to an exit state and a count, and maps of neighbouring chunks
compose. White space leads every state to the start, so words can be counted apart; a word of many
chunks is counted by a prefix scan over their maps.
"""

from __future__ import annotations

WORD_END = "</w>"
NEW = -1
START = 0

# The visible characters that stand for bytes in byte-level vocabularies.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_characters() -> dict[str, int]:
    """Character to byte: printed bytes stand for themselves, the others follow from U+0100."""
    rest = [b for b in range(256) if b not in set(_PRINTED)]
    return {chr(b): b for b in _PRINTED} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Compiled on demand: ``step`` by (state, byte) has (state, change of the count), ``close`` by
    state what leaving the word adds.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], most_states: int = 1 << 17):
        to_byte = byte_characters()

        def split(token: str) -> tuple[bytes, bool]:
            end = token.endswith(WORD_END) and len(token) > len(WORD_END)
            body = token[: -len(WORD_END)] if end else token
            return bytes(to_byte[c] for c in body), end

        self.tokens: dict[tuple[bytes, bool], int] = {}
        for token, number in vocabulary.items():
            if all(c in to_byte for c in token.removesuffix(WORD_END)):
                self.tokens[split(token)] = number
        self.text = {number: key for key, number in self.tokens.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            (x, _), (y, end) = split(a), split(b)
            self.rank[self.tokens[(x, False)], self.tokens[(y, end)]] = rank, self.tokens[(x + y, end)]
        # Proper prefixes of tokens: a start stays open while its bytes are one of them.
        self.open = {body[:k] for body, end in self.tokens for k in range(1, len(body) + end)}
        self.longest = max((len(body) for body, _ in self.tokens), default=1)
        self.most_states = most_states
        self.stable: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all states but the start."""
        self.number: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.close: list[int] = []
        self.step: dict[int, tuple[int, int]] = {}
        # (bytes, token before, count before) of open starts; at the start of a word nothing precedes.
        self._state((((b"", NEW, 0),), 0))

    def tokenize(self, body: bytes, end: bool) -> list[int]:
        """Merges in the order of their ranks, leftmost first."""
        last = len(body) - 1
        parts = [self.tokens[(body[i : i + 1], end and i == last)] for i in range(len(body))]
        while len(parts) > 1:
            ranks = [self.rank.get(pair, (1 << 30, 0)) for pair in zip(parts, parts[1:])]
            rank, merged = min(ranks)
            if rank == 1 << 30:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and ranks[i][0] == rank:
                    pair = (parts[i], parts[i + 1])
                    if self.rank.get(pair, (None,))[0] == rank:
                        out.append(merged)
                        i += 2
                        continue
                out.append(parts[i])
                i += 1
            parts = out
        return parts

    def _fits(self, before: int, token: int) -> bool:
        known = self.stable.get((before, token))
        if known is None:
            body, end = self.text[token]
            if before == NEW:
                known = self.tokenize(body, end) == [token]
            else:
                known = self.tokenize(self.text[before][0] + body, end) == [before, token]
            if len(self.stable) > 1 << 21:
                self.stable.clear()
            self.stable[before, token] = known
        return known

    def _state(self, key: tuple) -> int:
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.keys)
            self.keys.append(key)
            self.close.append(key[1])
        return found

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """Make one transition."""
        starts, _ = self.keys[state]
        one = bytes([byte])
        here = final = None
        for body, before, count in starts:
            grown = body + one
            if here is None:
                token = self.tokens.get((grown, False))
                if token is not None and self._fits(before, token):
                    here = (token, count + 1)
            if final is None:
                token = self.tokens.get((grown, True))
                if token is not None and self._fits(before, token):
                    final = count + 1
            if here is not None and final is not None:
                break
        token, count = here
        kept = [(body + one, before, n - count) for body, before, n in starts if body + one in self.open]
        kept.append((b"", token, 0))
        made = self.step[state << 8 | byte] = (self._state((tuple(kept), final - count)), count)
        return made

    def run(self, state: int, chunk: bytes) -> tuple[int, int]:
        """The chunk's map at one entry: exit state and count."""
        step, count = self.step, 0
        for byte in chunk:
            made = step.get(state << 8 | byte)
            if made is None:
                made = self.compile(state, byte)
            state, change = made
            count += change
        return state, count

    def count(self, word: bytes, chunk: int = 256) -> int:
        """Tokens of a word; an empty word has none."""
        if len(self.keys) > self.most_states:
            self.reset()
        if not word:
            return 0
        if len(word) <= chunk:
            state, count = self.run(START, word)
        else:
            state, count = self.scan([word[i : i + chunk] for i in range(0, len(word), chunk)])
        return count + self.close[state]

    def scan(self, pieces: list[bytes]) -> tuple[int, int]:
        """Exit state and count behind all chunks, by prefix composition of their maps.

        A map is tabulated for the entries that can occur: the start for the first chunk, for others
        what the bytes just before lead to. The scan doubles its reach each round; where a composed
        prefix reaches a chunk by an entry not tabulated yet, that entry is added.
        """
        margin = 2 * self.longest
        maps: list[dict[int, tuple[int, int]]] = []
        for i, piece in enumerate(pieces):
            entry = START if i == 0 else self.run(START, pieces[i - 1][-margin:])[0]
            maps.append({entry: self.run(entry, piece)})
        reach = 1
        total = list(maps)
        while reach < len(pieces):
            total = [
                self._compose(total[i - reach], total[i], pieces[i - reach + 1 : i + 1]) if i >= reach else total[i]
                for i in range(len(pieces))
            ]
            reach *= 2
        return total[-1][START]

    def _compose(self, first: dict, second: dict, pieces: list[bytes]) -> dict[int, tuple[int, int]]:
        """The map of two neighbouring stretches; ``pieces`` are the chunks of the second."""
        out = {}
        for entry, (middle, count) in first.items():
            if middle not in second:
                state, more = middle, 0
                for piece in pieces:
                    state, n = self.run(state, piece)
                    more += n
                second[middle] = (state, more)
            out[entry] = (second[middle][0], count + second[middle][1])
        return out
