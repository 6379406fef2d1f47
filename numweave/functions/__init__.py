"""Column expressions (no DataFrame work): text.py (number regex, masks, tokens,
Python float text), numeric.py (hash order, digits, log scale), vector.py and
sqlexpr.py (periodic features, layer norm, codebook logits, decoding)."""
