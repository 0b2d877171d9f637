"""Training-data operators over a `documents` table (doc_id, text, lang, source, n_chars).

Every operator takes and returns DataFrames.  Nothing outside this subpackage imports it.
Cases common to all operators: a null text counts as an empty one, a null doc_id is carried
through, repeated rows give repeated results, and columns that an operator doesn't name are
ignored whatever they are called.
"""
