"""Column expressions, all built-in (JVM side, whole-stage codegen)."""

from tablewright.functions.hashing import digest_sum, fingerprint, row_sha256, row_text, sha256_hex

__all__ = ["digest_sum", "fingerprint", "row_sha256", "row_text", "sha256_hex"]
