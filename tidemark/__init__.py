"""Signal, backtest and strategy-selection engine for panels of price bars."""
