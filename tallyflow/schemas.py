"""Field lists of the data model, as Spark DDL strings: fixed values, the names and types of the files and messages."""

USERS = "user_id int, age int, gender string, location string, interests string, signup_date date"

CAMPAIGNS_RAW = (
    "id int, AdvertiserName string, name string, start_date date, end_date date, "
    "targeting_criteria string, ad_slot_size string, budget decimal(15,2), "
    "remaining_budget decimal(15,2)"
)

EVENTS_RAW = (
    "EventID string, AdvertiserName string, CampaignName string, CampaignStartDate date, "
    "CampaignEndDate date, CampaignTargetingCriteria string, CampaignTargetingInterest string, "
    "CampaignTargetingCountry string, AdSlotSize string, UserID int, Device string, "
    "Location string, Timestamp timestamp, BidAmount float, AdCost float, WasClicked boolean, "
    "ClickTimestamp timestamp, AdRevenue float, Budget float, RemainingBudget float"
)

ADVERTISERS = "advertiser_id int, name string"

CAMPAIGNS = (
    "campaign_id int, advertiser_id int, name string, start_date date, end_date date, "
    "targeting_criteria string, ad_slot_size string, budget decimal(15,2), "
    "remaining_budget decimal(15,2)"
)

IMPRESSIONS = (
    "impression_id string, campaign_id int, user_id int, device string, location string, "
    "timestamp timestamp, bid_amount decimal(10,4), cost_paid decimal(10,4)"
)

CLICKS = (
    "click_id string, impression_id string, click_timestamp timestamp, "
    "revenue_generated decimal(10,4)"
)

REVIEWS_RAW = ", ".join(
    f"{name} string"
    for name in (
        "marketplace", "customer_id", "review_id", "product_id", "product_parent",
        "product_title", "product_category", "star_rating", "helpful_votes", "total_votes",
        "vine", "verified_purchase", "review_headline", "review_body", "review_date",
    )
)

PAGE_EVENT = (
    "meta struct<domain: string>, performer struct<user_id: bigint, user_is_bot: boolean>, "
    "created_at string, dt string, page_title string"
)

PROCESSED_EVENT = "user_id string, domain string, created_at string, page_title string"

MESSAGE = "value string"
