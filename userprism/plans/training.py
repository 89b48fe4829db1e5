"""From the four logs to the labelled training table."""

from pyspark.sql import functions as F

from ..operators import sparse
from ..operators.assemble import label_users, merge_features
from ..operators.cleaning import keep_columns
from ..operators.idsets import distinct_ids
from ..operators.scale import stage, without_steps
from ..sources.logs import read_logs
from ..sources.store import TableStore
from .attribution import attribution_features, attribution_rows, frequent_attribution
from .events import event_features, event_rows
from .positions import INSTRUMENTS, position_features, position_rows

# Features always added to a stored selection.
ALWAYS_KEPT = (
    "deals_per_balance_type_1_count", "instrument_strike_sum_balance_type_1",
    "ids_events_count", "instrument_strike_q75", "deals_per_position_type_long_count",
)


def user_ids(spark, config):
    """Distinct ids of (deposits, positions, events, attribution), each as a table."""
    deposits, positions, attribution, events = read_logs(spark, config)
    return tuple(distinct_ids(log) for log in (deposits, positions, events, attribution))


def training_table(deposits, positions, attribution, events, add_target=True, min_count=100,
                   instruments=INSTRUMENTS, staged=True):
    """One row per positions user: all features, zero where absent, and the label.

    The feature tables are staged, so that a train and a test split, or a second reader, only
    join them again. A caller that reads the table once has no use for that and its wide writes.
    """
    tables = (
        position_features(positions, instruments), event_features(events), attribution_features(attribution, min_count)
    )
    # Rows without a user have left the feature tables.
    merged = merge_features(*[stage(table) if staged else table for table in tables], key_present=True)
    return label_users(merged, deposits) if add_target else merged


def long_rows(positions, attribution, events, min_count=100, instruments=INSTRUMENTS, frequent=None):
    """(the features of all three logs in long form; one row per positions user), both staged.

    The logs' cleaned rows are deleted: nothing reads them after that.
    """
    def build():
        logs = (
            position_rows(positions, instruments), event_rows(events), attribution_rows(attribution, min_count, frequent)
        )
        long = None
        for rows, spec in logs:
            part = sparse.long_features(rows, spec)
            long = part if long is None else long.unionByName(part)
        return stage(long), stage(distinct_ids(logs[0][0]))

    return without_steps(positions.sparkSession, build)


def labelled_vectors(long, users, deposits, names=None):
    """(the staged vectors and labels of ``users``, the dictionary) of a staged long table."""
    labels = label_users(users, deposits).withColumn("target", F.col("target").cast("double"))
    return sparse.vectors(long, "user_id", labels, sparse.dictionary(long) if names is None else names)


def training_vectors(deposits, positions, attribution, events, min_count=100, instruments=INSTRUMENTS):
    """The training table for fits, with categories of any number of values.

    Returns (user_id, features, target), one sparse vector per positions user, and the table
    (name, index) of the features. No category value becomes a column or reaches the driver.
    """
    def build():
        long, users = long_rows(positions, attribution, events, min_count, instruments)
        return labelled_vectors(long, users, deposits)

    return without_steps(positions.sparkSession, build)


def selected_vectors(deposits, positions, attribution, events, threshold=0.2, learns=None, always=ALWAYS_KEPT,
                     min_count=100, instruments=INSTRUMENTS):
    """Training vectors of the features that correlate with the label, of those kept always too.

    The filter reads the long form, so any number of features passes it, and only those left enter
    the vectors, which a tree holds with a bin for every feature. ``learns`` is a condition on
    user_id: the users whose labels decide.
    """
    def build():
        long, users = long_rows(positions, attribution, events, min_count, instruments)
        labels = stage(label_users(users, deposits))
        seen = labels if learns is None else labels.filter(learns)
        cells = long if learns is None else long.filter(learns)
        found = sparse.target_correlation(cells, seen)
        chosen = found.filter((F.abs("correlation") > threshold) | F.col("name").isin(list(always)))
        return labelled_vectors(long, users, deposits, sparse.dictionary(chosen))

    return without_steps(positions.sparkSession, build)


def save_layout(store, names, attribution, min_count=100):
    """Store what lays out a later log like the training log: feature numbers and frequent values."""
    store.save("layout_names", names)
    store.save("layout_frequent", frequent_attribution(attribution, min_count))


def scoring_vectors(store, positions, attribution, events, instruments=INSTRUMENTS):
    """(user_id, features) of a later log's users in the stored layout.

    Values that were not frequent in training are bucketed as they were there, features that the
    layout does not know are ignored, and those that a user lacks are 0.
    """
    def build():
        frequent = store.load("layout_frequent")
        long, users = long_rows(positions, attribution, events, instruments=instruments, frequent=frequent)
        return sparse.vectors(long, "user_id", users, store.load("layout_names"))[0]

    return without_steps(positions.sparkSession, build)


def build_store(spark, config):
    """Compute and store the feature tables and the merged table; returns the merged table.

    With ``reuse_prepared`` the stored feature tables are joined again instead.
    """
    store = TableStore(spark, config.store)
    deposits, positions, attribution, events = read_logs(spark, config)
    if not config.reuse_prepared:
        store.save("positions", position_features(positions))
        store.save("events", event_features(events))
        store.save("attribution", attribution_features(attribution))
    merged = merge_features(store.load("positions"), store.load("events"), store.load("attribution"))
    return store.save("merged", label_users(merged, deposits))


def model_columns(table, selected, always=ALWAYS_KEPT):
    """The selected and always-kept features the table has, with label and id."""
    wanted = [*selected, *[c for c in always if c in table.columns]]
    return keep_columns(table, wanted)
