"""Plans that turn declared series into window columns and scans."""
