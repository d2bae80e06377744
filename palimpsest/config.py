"""Settings of the retrieval engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    # fixed values: widths, weights, probes and thresholds that results depend on
    token_bits: int = 4096
    bigram_bits: int = 3072
    context_bits: int = 3072
    token_weight: float = 0.50
    bigram_weight: float = 0.25
    context_weight: float = 0.25
    token_probes: int = 3
    token_bigram_probes: int = 2
    bigram_probes: int = 1
    context_probes: int = 1
    lsh_bands: int = 80
    lsh_rows: int = 2
    dirichlet_mu: float = 2000.0
    rrf_k: int = 10
    rerank_idf_weight: float = 0.30
    rerank_phrase_weight: float = 0.20
    rerank_len_weight: float = 0.05
    rerank_depth: int = 30
    chunk_saturation: float = 0.6
    query_probe_multiplier: float = 2.0
    max_token_features: int = 12
    dense_k: int = 128
    dense_probes: int = 4
    semantic_enabled: bool = True
    lexical_enabled: bool = True

    @property
    def bits(self) -> int:
        return self.token_bits + self.bigram_bits + self.context_bits

    @property
    def regions(self) -> tuple[tuple[str, int, int, float], ...]:
        """(name, first bit, end bit, weight) of the three regions."""
        a, b = self.token_bits, self.token_bits + self.bigram_bits
        return ("token", 0, a, self.token_weight), ("bigram", a, b, self.bigram_weight), ("context", b, self.bits, self.context_weight)

    def max_tokens(self) -> int:
        """Most tokens of a text that is kept whole: the token region's saturation is the first to be reached."""
        n = 0
        while ((n + 1) * self.token_probes + n * self.token_bigram_probes) / self.token_bits <= self.chunk_saturation:
            n += 1
        return n

    def max_pairs(self) -> int:
        n = int(self.chunk_saturation * self.bigram_bits / self.bigram_probes)
        return n if n * self.bigram_probes / self.bigram_bits <= self.chunk_saturation else n - 1
