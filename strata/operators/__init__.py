"""Lazy DataFrame operators over a mutation log (key, seq, kind, value)."""
