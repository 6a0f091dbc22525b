"""Registered report plans over the events-derived results log.

All measures are dyadic fractions, so sums are exact and means are
correctly rounded quotients: results are compared unrounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dualspace.operators import grid, report
from dualspace.sources.results import results_log


def _r(spark, sf_dir):
    return results_log(spark, sf_dir)


def q_table_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.table_accuracy(_r(spark, sf_dir))


def q_table_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.table_retrieval(_r(spark, sf_dir))


def q_table_wallclock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.table_wallclock(_r(spark, sf_dir))


def q_heatmap_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.heatmap_f1(_r(spark, sf_dir), ["emb0", "emb1"])


def q_bar_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.bar_f1(_r(spark, sf_dir))


def q_scatter_recall_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.scatter_recall_f1(_r(spark, sf_dir))


def q_dim_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.dim_ablation(_r(spark, sf_dir))


def q_exec_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.exec_summary(_r(spark, sf_dir))


def q_report_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_meta(_r(spark, sf_dir))


def q_gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.gallery(_r(spark, sf_dir), 10, 0)


def q_cell_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.cell_summary(_r(spark, sf_dir))


def q_running_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.running_means(_r(spark, sf_dir), block=1024)


def q_grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid.expand_grid(grid.config_from_results(_r(spark, sf_dir)))
    return cells.select(grid.cell_label().alias("label"), *grid.CELL)


def q_pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _r(spark, sf_dir)
    cells = grid.expand_grid(grid.config_from_results(r))
    return grid.pending_work(cells, r.select("dataset", "qid").distinct(), r)


QUERIES = {
    "table_accuracy": q_table_accuracy,
    "table_retrieval": q_table_retrieval,
    "table_wallclock": q_table_wallclock,
    "heatmap_f1": q_heatmap_f1,
    "bar_f1": q_bar_f1,
    "scatter_recall_f1": q_scatter_recall_f1,
    "dim_ablation": q_dim_ablation,
    "exec_summary": q_exec_summary,
    "report_meta": q_report_meta,
    "gallery": q_gallery,
    "cell_summary": q_cell_summary,
    "running_means": q_running_means,
    "grid_cells": q_grid_cells,
    "pending_work": q_pending_work,
}
