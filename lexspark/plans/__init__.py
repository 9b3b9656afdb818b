"""Query text to plan, on the driver."""
