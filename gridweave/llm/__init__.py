"""Training-data operators: scoring, filtering, extraction, formatting, tokenising and de-duplication.

Every operator takes DataFrames and returns DataFrames. Common conventions:

* A null text is the empty text. A null ``doc_id`` is one document with the smallest id there is.
* Rows that repeat one ``doc_id`` are told apart by their text where a result is joined back to rows.
* Operators select the columns they need, so extra columns never clash with theirs.
* Tables that are read more than once are cut with ``checkpoint()`` into ``spark.checkpoint.dir``.
"""
