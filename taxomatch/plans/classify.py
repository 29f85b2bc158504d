"""Composite classification jobs.

All jobs take long-format vector frames (see ``operators.knn``):

    product_vecs  : model, uid, vec
    category_docs : model, doc_ord, path, cat_type, vec

and return one answer row per product (``_id``, ``category``).  The loops of
a per-product script (products x models x lists) are key columns here: the
search emits every list at once, the votes are one aggregate and the winner
a second one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxomatch.operators import knn as K
from taxomatch.operators import vote as V
from taxomatch.operators.rows import range_slices


def classify_direct(product_vecs: DataFrame, category_docs: DataFrame, **kw) -> DataFrame:
    """Nearest category document over ALL and LAST documents together (k=1)."""
    hits = K.nearest(product_vecs, category_docs, **kw)
    return hits.select(F.col("uid").alias("_id"), F.col("path").alias("category"))


def vote_hits(product_vecs: DataFrame, category_docs: DataFrame, k: int,
              methods=("sim", "mmr"), **kw) -> DataFrame:
    """The hit lists that vote: every model x method x type, ranked, with centivotes."""
    hits = K.search(product_vecs, category_docs, k, methods=methods, by_type=True, **kw)
    return V.rank_votes(hits, k)


def classify_vote(product_vecs: DataFrame, category_docs: DataFrame, k: int = 10,
                  methods=("sim", "mmr"), **kw) -> DataFrame:
    """C2 (one model) / C3 (several models in ``model``): 4 lists per model, votes, winner."""
    voted = vote_hits(product_vecs, category_docs, k, methods=methods, **kw)
    return V.answers(V.vote_winner(V.vote_box(voted)))


def classify_ensemble(product_vecs: DataFrame, category_docs: DataFrame, k: int = 5,
                      methods=("sim", "mmr"), **kw) -> DataFrame:
    """The same vote over every model present in the ``model`` column.

    U2: the ensemble is the set of values of ``model`` - one pass over all
    models, not a loop; adding a model is adding its rows.
    """
    return classify_vote(product_vecs, category_docs, k=k, methods=methods, **kw)


def classify_in_slices(product_vecs: DataFrame, category_docs: DataFrame, n_slices: int,
                       k: int = 5, **kw) -> DataFrame:
    """The ensemble, its answers in ``n_slices`` key ranges.

    The search runs over all products with Spark's own partitions; only the
    answers are dealt into ranges, so a writer gives one file per slice.  No
    product is dropped and every answer uses the vector of its own product.
    """
    return range_slices(classify_ensemble(product_vecs, category_docs, k=k, **kw), n_slices, "_id")


def search_report(product_vecs: DataFrame, category_docs: DataFrame, k: int = 10,
                  fetch_k: int = K.DEFAULT_FETCH_K, **kw) -> DataFrame:
    """Both similarity lists and both MMR lists, with distances, per product."""
    return K.search(product_vecs, category_docs, k, methods=("sim", "mmr"), fetch_k=fetch_k,
                    by_type=True, **kw)


# --------------------------------------------------------------------------- texts and files

def search_texts(texts: DataFrame, embed, category_docs: DataFrame, k: int = 10,
                 methods=("sim", "mmr"), model: str = "default", **kw) -> DataFrame:
    """Hit lists for ad-hoc texts (``uid``, ``text``), embedded on the fly.

    ``embed`` maps a frame with ``id``, ``text`` to the same rows with ``vec``.
    """
    vecs = embed(texts.select(F.col("uid").alias("id"), "uid", "text"))
    q = vecs.select(F.lit(model).alias("model"), "uid", "vec")
    return K.search(q, category_docs.withColumn("model", F.lit(model)), k, methods=methods, **kw)


def classify_with_word_vectors(products: DataFrame, categories: DataFrame, word_vectors: DataFrame,
                               dim: int, k: int = 10, approach: str = "direct", **kw) -> DataFrame:
    """Mean word vectors (V3) of product texts (T9) and category documents
    (paths cleaned as paths), then the direct or the vote classification."""
    from taxomatch.functions import text as TX
    from taxomatch.operators import docs as D
    from taxomatch.operators import words as W

    from taxomatch.session import materialize

    cdocs = D.category_documents(categories)
    cv = W.mean_vectors(cdocs, "doc_ord", F.col("text"), word_vectors, dim)
    items = cdocs.select("doc_ord", "path", "cat_type").join(cv.select("doc_ord", "vec"), "doc_ord")
    ptext = products.select("uid", TX.product_word_text("title", "vendor_category").alias("text"))
    # written once: the search sizes its blocks from the vectors, then reads them
    pv = materialize(W.mean_vectors(ptext, "uid", F.col("text"), word_vectors, dim).select("uid", "vec"),
                     "product-word-vectors")
    if approach == "direct":
        return classify_direct(pv, items, **kw)
    return classify_vote(pv, items, k=k, **kw)


def classify_files(spark, categories_csv: str, products_csv: str, store_root: str,
                   models: dict, answers_dir: str, approach: str = "ensemble", k: int | None = None,
                   principal: str | None = None, **kw) -> DataFrame:
    """The whole job from the two CSV files to the answer folder.

    * categories -> ALL/LAST documents, products -> product texts (T7);
    * both sides embedded with every model in ``models`` (name -> embedder),
      only documents not yet in the collections (insert-if-absent);
    * ``approach``: ``direct`` (k=1 over ALL+LAST, model ``principal``),
      ``vote`` (4 lists, k=10, model ``principal``) or ``ensemble`` (4 lists per
      model, k=5, all models);
    * answers written as JSON lines; the answer frame is returned.
    """
    from taxomatch.functions import text as TX
    from taxomatch.operators import docs as D
    from taxomatch.sources import answers as A
    from taxomatch.sources import collections as S
    from taxomatch.sources import csv as CSV

    store = S.VectorStore(spark, store_root)
    cats = CSV.read_categories(spark, categories_csv)
    cdocs = D.category_documents(cats)
    # the position id of the reference plus a hash of what it points at, so an
    # edited category file never reuses a stale vector (same rule as products)
    cdocs = cdocs.withColumn("id", F.concat_ws(":", "id", F.lower(F.hex(F.xxhash64("path", "cat_type")))))
    prods = CSV.read_products(spark, products_csv)
    pdocs = D.product_documents(prods.select("uid", TX.product_text("title", "vendor_category").alias("text")))
    store.add_missing(cdocs, S.CATEGORIES, models)
    store.add_missing(pdocs, S.PRODUCTS, models)
    principal = principal or next(iter(models))
    use = list(models) if approach == "ensemble" else [principal]
    names = [S.collection_name_py(m) for m in use]
    # documents of the current files only (older ones stay stored, unused)
    items = (store.vectors(S.CATEGORIES).where(F.col("model").isin(names))
             .join(cdocs.select("id"), "id", "left_semi")
             .select("model", "doc_ord", "path", "cat_type", "vec"))
    # current product texts only: ids carry the text hash, so stale vectors are skipped
    queries = (store.vectors(S.PRODUCTS).where(F.col("model").isin(names))
               .join(pdocs.select("id"), "id", "left_semi").select("model", "uid", "vec"))
    if approach == "direct":
        ans = classify_direct(queries, items, **kw)
    else:
        ans = classify_vote(queries, items, k=k or (10 if approach == "vote" else 5), **kw)
    A.write_answers(ans, answers_dir)
    return A.read_answers(spark, answers_dir)
