"""DataFrame to DataFrame operators; every one takes `keys` and works on all series at once."""
