"""DataFrame operators over trades, candles, books and levels."""
