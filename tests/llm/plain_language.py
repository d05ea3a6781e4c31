"""The language model in plain Python, by its description alone: what the operator is compared with."""

import math
import zlib
from collections import Counter

import xxhash

SAMPLE, LONGEST = 1000, 5


def words(text):
    return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()


class PlainModel:
    """Word-first backoff over rows (doc_id, text, lang), learned from those whose crc32(doc_id) mod 4 is not 2.

    Of languages with over SAMPLE such rows a share is taken by a hash of the id. Frequencies are smoothed by a half.
    """

    def __init__(self, rows):
        rows = [(i, t, g) for i, t, g in rows if i is not None and g is not None and zlib.crc32(str(i).encode()) % 4 != 2]
        sizes = Counter(g for _, _, g in rows)
        self.langs = sorted(sizes)
        counts = [{g: Counter() for g in self.langs} for _ in range(LONGEST + 1)]  # by length; words at 0
        for i, text, lang in rows:
            if self._place(str(i)) < min(1.0, SAMPLE / sizes[lang]):
                counts[0][lang].update(words(text))
        for lang in self.langs:
            for word, n in counts[0][lang].items():
                padded = f"<{word}>"
                for size in range(1, LONGEST + 1):
                    for gram in {padded[k : k + size] for k in range(max(1, len(padded) - size + 1))}:
                        if len(gram) == size:
                            counts[size][lang][gram] += n
        self.logs = []
        for tables in counts:
            keys = {k for t in tables.values() for k in t}
            total = {g: sum(tables[g].values()) + 0.5 * (len(keys) + 1) for g in self.langs}
            self.logs.append({k: [math.log((tables[g][k] + 0.5) / total[g]) for g in self.langs] for k in keys})

    @staticmethod
    def _place(key):
        seeded = xxhash.xxh64_intdigest(b"sample", 42)
        return xxhash.xxh64_intdigest(key.encode(), seeded) % (1 << 20) / (1 << 20)

    def scores(self, word):
        """Log scores per language of a word; None if no character of it is known."""
        if word in self.logs[0]:
            return self.logs[0][word]
        padded = f"<{word}>"
        for size in range(LONGEST, 0, -1):
            known = self.logs[size]
            grams = [padded[k : k + size] for k in range(len(padded) - size + 1) if padded[k : k + size] in known]
            if grams and (size > 1 or any(c in known for c in word)):
                return [sum(known[g][i] for g in grams) / len(grams) for i in range(len(self.langs))]
        return None

    def predict(self, text):
        own = words(text)
        if not own or not self.langs:
            return "und", 0.0
        found = [s for s in map(self.scores, own) if s is not None]
        totals = [math.fsum(s[i] for s in found) for i in range(len(self.langs))]
        best = max(range(len(totals)), key=lambda i: (totals[i], -i))
        return self.langs[best], 1 / math.fsum(math.exp(max(-700, t - totals[best])) for t in totals)
