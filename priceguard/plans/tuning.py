"""Threshold analysis: sweep, grid and best settings from tables scored once."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TUNED, Settings
from ..operators import context, evaluate, forest, stats
from ..operators.evaluate import GRID


def grid_input(events: DataFrame, settings: Settings = TUNED, use_forest: bool = False) -> DataFrame:
    """The table ``grid_search`` reads: deviations, context and labels.

    Contamination moves only the forest's threshold, so one forest serves all its values.
    """
    train = evaluate.train_test(events).filter("split = 'train'").drop("split")
    st, base = stats.category_stats(train, surge_tails=False), context.baselines(train)
    rows = stats.rolling_deviations(context.score(events, base, settings), settings)
    raw = stats.with_stats(rows, st)
    both = raw.crossJoin(F.broadcast(stats.batch_maxima(stats.with_stats(events, st))))
    parts = [F.coalesce(w * F.col(c) / F.col(f"{c}_max"), F.lit(0.0)) for w, c in ((0.35, "z_dev"), (0.35, "mad_dev"), (0.20, "iqr_dev"))]
    out = both.withColumn("parts", parts[0] + parts[1] + parts[2])
    if use_forest:
        model = forest.IsolationForest(GRID["contamination"][0], settings.trees, settings.seed).fit(train, threshold=False)  # the cuts below are its thresholds
        raw_score = model.predict(events).select("event_id", "if_score", "if_raw_score")
        trained = raw_score.join(train.select("event_id"), "event_id")
        cuts = trained.agg(*[F.percentile_approx("if_raw_score", c, 100_000).alias(f"cut_{c}") for c in GRID["contamination"]])
        flagged = raw_score.crossJoin(F.broadcast(cuts)).select("event_id", "if_score", *[(F.col("if_raw_score") < F.col(f"`cut_{c}`")).alias(f"if_{c}") for c in GRID["contamination"]])
        out = out.join(flagged, "event_id")
    return evaluate.train_test(out)


def grid_results(events: DataFrame, settings: Settings = TUNED, use_forest: bool = True) -> dict:
    """grid (on the earlier half of the held-out rows, by time), its best settings, and all settings judged on the later half, which chose nothing."""
    table = evaluate.time_folds(grid_input(events, settings, use_forest).filter("split = 'test'"), 2, evaluate.train_test(events).filter("split = 'test'"))
    both = evaluate.grid_search(table, settings=settings, by=("fold",))
    grid, judged = both.filter("fold = 0").drop("fold"), both.filter("fold = 1").drop("fold")
    return {"grid": grid, "best": evaluate.best_row(grid), "judged": judged}


def analyse(events: DataFrame, scored: DataFrame, settings: Settings = TUNED, use_forest: bool = True) -> dict:
    """sweep and pr_auc of scored rows, and what ``grid_results`` gives."""
    sweep = evaluate.threshold_sweep(scored.filter("split = 'test'"))
    return {"sweep": sweep, "pr_auc": evaluate.pr_auc(sweep)} | grid_results(events, settings, use_forest)


def save_results(results: dict[str, DataFrame], folder: str) -> None:
    """Each result table as one CSV file: they have at most a few hundred rows."""
    for name, df in results.items():
        df.coalesce(1).write.mode("overwrite").csv(f"{folder}/{name}", header=True)


def optimised_run(events: DataFrame, results: dict, settings: Settings = TUNED, use_forest: bool = True) -> tuple[Settings, DataFrame]:
    """Settings of the grid's best row, and the evaluation of a run with them on the later half of the held-out rows, which chose nothing."""
    from dataclasses import replace

    from .pipeline import detect

    best = results["best"].first()
    chosen = replace(
        settings, zscore_threshold=best["zscore_threshold"], ensemble_threshold=best["ensemble_threshold"],
        contamination=best["contamination"] if "contamination" in results["best"].columns else settings.contamination,
    )
    later = evaluate.time_folds(detect(events, chosen, use_forest).filter("split = 'test'"), 2, evaluate.train_test(events).filter("split = 'test'")).filter("fold = 1")
    return chosen, evaluate.prf_by_method(later)


def main(args: list[str] | None = None) -> None:
    """Command line: --folder OUT --end-date D [--sample N] [--no-forest]: sweep, grid and best settings of generated events."""
    import argparse
    import datetime as dt

    from pyspark.sql import SparkSession

    from ..sources.generator import generate
    from ..sources.scratch import written
    from ..sources.trips import sample_rows
    from .pipeline import detect

    p = argparse.ArgumentParser()
    p.add_argument("--folder", required=True)
    p.add_argument("--end-date", type=dt.datetime.fromisoformat, required=True)
    p.add_argument("--sample", type=int)
    p.add_argument("--no-forest", action="store_true")
    a = p.parse_args(args)
    events, _ = generate(SparkSession.builder.getOrCreate(), a.end_date)
    if a.sample is not None:
        events = sample_rows(events, a.sample)
    events = written(events, "events")
    results = analyse(events, written(detect(events, TUNED, not a.no_forest), "scored"), TUNED, not a.no_forest)
    save_results(results | {"optimised": optimised_run(events, results, TUNED, not a.no_forest)[1]}, a.folder)


if __name__ == "__main__":
    main()
