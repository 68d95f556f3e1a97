"""Tables in and out: payloads, quotes, specs, ledgers and bars."""
