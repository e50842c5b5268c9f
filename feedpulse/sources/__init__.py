"""feedpulse.sources"""
