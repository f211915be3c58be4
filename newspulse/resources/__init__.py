"""Small hand-written tables: lexicon, gazetteer, stopwords, pattern families, site selectors."""
