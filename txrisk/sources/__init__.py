from txrisk.sources.raw import read_raw, smoke_slice, time_range  # noqa: F401
from txrisk.sources.testbind import TEST_SPLITS, tx_view, read_table  # noqa: F401
