"""Usage-cost analytics on Spark: metering, attribution, trends and forecasts as lazy DataFrame functions."""
